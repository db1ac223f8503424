"""Problem 4: one consistent form for text that looks the same but differs in its characters.

Each Arrow batch becomes a DuckDB relation and one embedded SQL statement rewrites it: invisible characters are removed,
blanks, widths, joined letters and hyphens mapped, ``nfc_normalize`` composes accents, and words that mix alphabets are
put into their own. Values of plain ASCII are canonical already and stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folivane.llm import lookalike as L
from folivane.sources.tables import table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(column: str, source: str) -> str:
    """SQL that adds ``canonical`` to the rows of ``source``."""
    marks = "".join(L.INVISIBLE)
    mapped = f"translate(regexp_replace({column}, {_q('[' + marks + ']')}, '', 'g'), {_q(''.join(L.ONE))}, {_q(''.join(L.ONE.values()))})"
    for joined, letters in L.MANY.items():
        mapped = f"replace({mapped}, {_q(joined)}, {_q(letters)})"
    both = L.CYRILLIC + L.GREEK
    latin = L.AS_LATIN_C + L.AS_LATIN_G
    sure_latin = "[" + "".join(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in L.TO_CYRILLIC) + "À-ɏ]"
    # Letters of the alphabet that are in the table can't tell the alphabet of a word.
    sure = f"(CASE WHEN regexp_matches({{w}}, {_q(sure_latin)}) THEN 'L' WHEN regexp_matches(translate({{w}}, {_q(both)}, ''), '\\p{{Cyrillic}}') THEN 'C' WHEN regexp_matches(translate({{w}}, {_q(both)}, ''), '\\p{{Greek}}') THEN 'G' ELSE '' END)"
    script = lambda w: sure.replace("{w}", w).replace("{{", "{").replace("}}", "}")
    to_cyr = "".join(L.TO_CYRILLIC), "".join(L.TO_CYRILLIC.values())
    return f"""
    WITH plain AS (
        SELECT *, nfc_normalize({mapped}) AS flat FROM {source}
    ), cut AS (
        SELECT *, CASE WHEN regexp_matches(flat, '[\\p{{Cyrillic}}\\p{{Greek}}]')
            THEN regexp_extract_all(flat, '\\pL+|[^\\pL\\n]+|\\n') END AS pieces
        FROM plain
    ), told AS (
        SELECT *, list_transform(pieces, lambda w: CASE WHEN w = chr(10) THEN 'N' WHEN regexp_matches(w, '^\\pL') THEN {script('w')} ELSE '-' END) AS scripts
        FROM cut
    )
    SELECT * EXCLUDE (flat, pieces, scripts), CASE WHEN pieces IS NULL THEN flat ELSE array_to_string(list_transform(pieces, lambda w, i:
        CASE WHEN scripts[i] IN ('-', 'N', 'G') OR NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN w
             WHEN scripts[i] = 'C' THEN translate(w, {_q(to_cyr[0])}, {_q(to_cyr[1])})
             WHEN scripts[i] = 'L' THEN translate(w, {_q(both)}, {_q(latin)})
             WHEN i > 2 AND scripts[i - 1] = '-' AND scripts[i - 2] IN ('C', 'G') OR scripts[i + 1] = '-' AND coalesce(scripts[i + 2], '') IN ('C', 'G') THEN w
             ELSE translate(w, {_q(both)}, {_q(latin)}) END), '') END AS canonical
    FROM told"""


def _rewriter(columns: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        sql = canonical_sql("value", "part")
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch]))
            out = con.sql(sql).to_arrow_table().select([*columns, "canonical"])
            con.unregister("part")
            yield from out.combine_chunks().to_batches()
        con.close()

    return run


def canonicalise(values: DataFrame) -> DataFrame:
    """``values`` has a STRING column ``value`` and any others; the result has ``canonical`` besides.

    Null stays null, '' stays ''. Rows keep their number and other columns; equal values get equal forms, whatever
    their length. A column of the name ``canonical`` that is there already is replaced.
    """
    values = values.drop("canonical")
    odd = F.col("value").rlike(r"[^\x00-\x7F]")
    plain = values.where(F.coalesce(~odd, F.lit(True))).withColumn("canonical", F.col("value"))
    schema = values.withColumn("canonical", F.lit(None).cast("string")).schema
    return plain.unionByName(values.where(odd).mapInArrow(_rewriter(values.columns), schema))


def _fields(chunks: DataFrame) -> DataFrame:
    """One row for each value of ``text`` and ``heading``."""
    return chunks.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("text", "heading")])).alias("f")).select("id", "f.field", "f.value")


def found(spark: SparkSession, base: str) -> DataFrame:
    """Values of ``chunks`` that are not in the canonical form. A null has none."""
    done = canonicalise(_fields(table(spark, base, "chunks", "id", "text", "heading")))
    return done.where("value <> canonical").select(F.col("id").alias("chunk_id"), "field").distinct()


def clean(spark: SparkSession, base: str) -> DataFrame:
    """Every id of ``chunks`` with both values in their canonical form."""
    done = canonicalise(_fields(table(spark, base, "chunks", "id", "text", "heading")))
    pick = lambda n: F.max(F.when(F.col("field") == n, F.col("canonical"))).alias(n)
    return done.groupBy(F.col("id").alias("chunk_id")).agg(pick("text"), pick("heading"))


SQL_FOUND = f"""WITH fields AS (SELECT id AS chunk_id, 'text' AS field, text AS value FROM chunks UNION ALL SELECT id, 'heading', heading FROM chunks), told AS ({canonical_sql("value", "fields")})
    SELECT DISTINCT chunk_id, field FROM told WHERE value <> canonical"""
SQL_CLEAN = f"""WITH fields AS (SELECT id, 'text' AS field, text AS value FROM chunks UNION ALL SELECT id, 'heading', heading FROM chunks), told AS ({canonical_sql("value", "fields")})
    SELECT id AS chunk_id, max(canonical) FILTER (WHERE field = 'text') AS text, max(canonical) FILTER (WHERE field = 'heading') AS heading FROM told GROUP BY id"""
