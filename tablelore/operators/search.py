"""Lexical search over documents or over stored facts.

The query's terms are known when the plan is built, so a document is scored by
expressions on its own row.  Only three numbers per corpus (documents, average length,
documents per term) are aggregated, and only the best rows are sorted.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import terms


def query_terms(query: str) -> list[str]:
    """Terms of the query in order, by the same rule as ``functions.text.terms``."""
    out = []
    for term in re.findall(fixed.TOKEN_PATTERN, query.lower()):
        out.append(term)
        if re.search("[-_]", term):
            out.extend(re.split("[-_]", term))
    return out


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def rank_documents(
    docs: DataFrame,
    query: str,
    weights: Mapping[str, int],
    names: Sequence[str] = (),
    excerpt: str | None = None,
    order: Sequence[str] = (),
    limit: int = 5,
) -> DataFrame:
    """The best documents for a query, by BM25 plus a bonus for names and phrases.

    ``weights`` maps text columns to the weight of their terms.  ``names`` are the
    columns holding table and column names, ``order`` breaks ties.
    """
    asked = query_terms(query)
    distinct = list(dict.fromkeys(asked))
    if not distinct:
        return docs.limit(0).select("*", F.lit(0.0).alias("score"), F.array().cast(
            "array<string>").alias("matched_terms"))

    def hits(field: str, term: str) -> Column:
        found = F.col(f"_t_{field}")
        return F.size(found) - F.size(F.array_remove(found, term))

    def counted(rows: DataFrame) -> DataFrame:
        """Rows with their length and the frequency of every query term."""
        termed = rows.select("*", *[terms(F.col(f)).alias(f"_t_{f}") for f in weights])
        return termed.select(
            *docs.columns,
            _add([w * F.size(f"_t_{f}") for f, w in weights.items()]).cast("bigint").alias(
                "_len"),
            *[_add([w * hits(f, t) for f, w in weights.items()]).cast("bigint").alias(f"_tf{i}")
              for i, t in enumerate(distinct)],
        )

    corpus = counted(docs).agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.sum("_len").alias("length"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))],
    )).scalar()
    # A document without any query term as part of its text cannot score; finding that
    # out is cheaper than taking the text apart.
    texts = list(dict.fromkeys([*weights, *names, *([excerpt] if excerpt else [])]))
    lowered = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in texts]
    possible = reduce(lambda x, y: x | y, [
        F.contains(c, F.lit(t)) for c in lowered for t in distinct])
    scored = counted(docs.where(possible)).withColumn("_c", corpus)
    n = F.col("_c.n")
    average = F.col("_c.length") / n
    norm = F.lit(fixed.BM25_K1) * (
        F.lit(1.0 - fixed.BM25_B) + F.lit(fixed.BM25_B) * F.col("_len") / average)
    parts = []
    for i, term in enumerate(distinct):
        tf, df = F.col(f"_tf{i}"), F.col(f"_c.df{i}")
        idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
        parts.append(F.when(tf > 0, F.lit(float(asked.count(term))) * idf
                            * (tf * F.lit(fixed.BM25_K1 + 1) / (tf + norm)))
                     .otherwise(F.lit(0.0)))
    score = _add(parts) + _bonus(query, distinct, names, excerpt)
    matched = F.array_compact(F.array(*[
        F.when(F.col(f"_tf{i}") > 0, F.lit(t)) for i, t in enumerate(distinct)]))
    return (
        scored.withColumn("_raw", score)
        .withColumn("score", F.round("_raw", 3))
        # Documents without a hit sort last, so they can be dropped after the cut.
        .orderBy(F.desc("score"), F.col("_raw") <= 0, *order)
        .limit(max(limit, 0))
        .where(F.col("_raw") > 0)
        .select(*docs.columns, "score", matched.alias("matched_terms"))
    )


def _bonus(query: str, distinct: Sequence[str], names: Sequence[str],
           excerpt: str | None) -> Column:
    phrase = query.lower().strip()
    if not phrase:
        return F.lit(0.0)
    asked = F.array(*[F.lit(t) for t in distinct])
    bonus = F.lit(0.0)
    if names:
        lowered = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in names]
        same = reduce(lambda a, b: a | b, [c == phrase for c in lowered])
        inside = reduce(lambda a, b: a | b, [F.contains(c, F.lit(phrase)) for c in lowered])
        bonus = (bonus + F.when(same, fixed.SAME_NAME_BONUS).otherwise(0.0)
                 + F.when(inside, fixed.NAME_CONTAINS_BONUS).otherwise(0.0))
        bonus = bonus + _add([
            F.size(F.array_intersect(terms(F.col(c)), asked)) for c in names
        ]) * F.lit(fixed.NAME_TERM_BONUS)
    if excerpt:
        bonus = bonus + F.when(
            F.contains(F.lower(F.coalesce(F.col(excerpt), F.lit(""))), F.lit(phrase)),
            fixed.EXCERPT_CONTAINS_BONUS).otherwise(0.0)
    return bonus


def fact_documents(facts: DataFrame) -> DataFrame:
    """Current facts folded to one document per table and per column."""
    text = F.coalesce(
        F.when(F.size("values") > 0, F.array_join("values", ", ")),
        F.when((F.col("field") == "pii") & F.lower("value").isin("true", "false"),
               F.concat(F.lit("pii sensitive "), F.lower("value"))),
        F.when(~F.startswith(F.trim("value"), F.lit("<")) & (F.trim("value") != ""),
               F.trim("value")),
        F.lit(""),
    )
    fields = list(dict.fromkeys([
        *fixed.TABLE_DOC_WEIGHTS, *fixed.COLUMN_DOC_WEIGHTS]))
    fields = [f for f in fields if f not in ("table_name", "column_name")]
    docs = facts.groupBy("table_name", "column_name").agg(*[
        F.coalesce(F.max(F.when(F.col("field") == f, text)), F.lit("")).alias(f)
        for f in fields
    ])

    def labelled(label: str, field: str) -> Column:
        return F.when(F.col(field) != "", F.concat(F.lit(label), F.col(field)))

    def plain(field: str) -> Column:
        return F.when(F.col(field) != "", F.col(field))

    about_table = F.concat_ws(
        " | ", plain("table_description"), labelled("Owner: ", "data_owner"),
        labelled("Update: ", "update_frequency"), plain("notes"),
        labelled("Comment: ", "table_comment"))
    about_table = F.when(about_table == "", fixed.NO_DESCRIPTION).otherwise(about_table)
    about_column = F.concat_ws(
        " | ",
        F.concat(F.col("column_name"),
                 F.when(F.col("type") != "", F.concat(F.lit(" ("), F.col("type"), F.lit(")")))
                 .otherwise(F.lit(""))),
        plain("description"), labelled("Valid values: ", "valid_values"),
        labelled("PII: ", "pii"))
    is_table = F.col("column_name").isNull()
    return docs.withColumn("kind", F.when(is_table, "table").otherwise("column")).withColumn(
        "excerpt", F.when(is_table, about_table).otherwise(about_column))


_RATIONALE = (
    ("column_name", "column name"), ("table_name", "table name"),
    ("description", "description"), ("table_description", "description"),
    ("valid_values", "valid values"), ("data_owner", "owner"), ("notes", "notes"),
    ("pii", "PII flag"),
)


def _by_weight(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """One text column per weight, holding the fields that carry it."""
    tables, columns = fixed.TABLE_DOC_WEIGHTS, fixed.COLUMN_DOC_WEIGHTS
    levels = sorted({*tables.values(), *columns.values()}, reverse=True)

    def text(table: Mapping[str, int], level: int) -> Column:
        return F.concat_ws("\n", *[F.col(f) for f, w in table.items() if w == level])

    texts = {
        f"weight_{level}": F.when(F.col("kind") == "table", text(tables, level))
        .otherwise(text(columns, level)) for level in levels
    }
    return docs.withColumns(texts), {f"weight_{level}": level for level in levels}


def search_facts(facts: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The tables and columns whose stored facts fit a query, with the reason."""
    docs, weights = _by_weight(fact_documents(facts))
    ranked = rank_documents(
        docs, query, weights, names=("table_name", "column_name"), excerpt="excerpt",
        order=("table_name", "column_name", "kind"), limit=limit,
    )
    # The reason is only worked out for the documents that are returned.
    asked = F.array(*[F.lit(t) for t in dict.fromkeys(query_terms(query))]).cast(
        "array<string>")

    def reason(field: str, label: str) -> Column:
        found = F.array_sort(F.array_intersect(terms(F.col(field)), asked))
        return F.when(F.size(found) > 0, F.concat(
            F.lit(label + ": "), F.array_join(found, ", ")))

    reasons = F.slice(F.array_compact(F.array(*[
        reason(field, label) for field, label in _RATIONALE])), 1, 3)
    why = F.array_join(reasons, "; ")
    return ranked.select(
        "kind", "table_name", "column_name", "score", "matched_terms",
        F.when(why == "", fixed.GENERAL_MATCH).otherwise(why).alias("rationale"),
        "excerpt",
    )
