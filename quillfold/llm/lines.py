"""Line dedup: lines that many documents hold stay in one document only.

A line's key is the line without white space at both ends, A-Z lower-cased. Lines of each document are exploded with
their positions, and of a key only 128 bits of its SHA-256 travel. Distinct documents are counted for each hash (a hot line
costs a row for each document, spread by hash and document, then one for each task), the lines of hashes over the threshold meet
the largest id that holds them, and each text is put together again from the runs of lines between the dropped positions.
No text is shuffled but once, to meet its own dropped positions; no group of lines is ever gathered but those of one document.

Defined results: a null or empty text is one empty line; documents are told apart by id, so rows of one id count once and a
null id is one document, smaller than all others; each row is put together from its own text, and repeated rows each come back;
several texts of an id are kept apart by a hash of the text; if two of one line's documents share the largest id (rows of one id),
both keep it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import materialise

SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """The line as it is compared; most lines are ASCII, where lower() is the same and faster."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _marked(docs: DataFrame) -> DataFrame:
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", whole.alias("text"), F.xxhash64(whole).alias("mark"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, mark (hash of the text), at (place of the line from 0) and h, of the lines whose key has min_chars code points."""
    parts = _marked(docs).select("doc_id", "mark", F.split("text", "\n", -1).alias("lines"))
    lines = parts.select("doc_id", "mark", F.posexplode("lines").alias("at", "line")).where(F.length(F.btrim("line", F.lit(SPACE))) >= min_chars)
    return lines.select("doc_id", "mark", "at", _hash(line_key(F.col("line"))).alias("h"))


def common_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h, n_docs and keeper (the largest id) of the hashes found in min_docs documents."""
    pairs = hashes.select("h", "doc_id").distinct()
    return pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def _without(text: Column, gone: Column) -> Column:
    """text without the lines at the ascending places `gone`: the runs between them, joined."""

    def runs(lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
        # Bound to lambda variables, so that neither is worked out again for each run.
        cut = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.slice(lines, F.get(e, i) + 2, F.get(e, i + 1) - F.get(e, i) - 1))
        return F.array_join(F.flatten(F.flatten(F.transform(F.array(edges), cut))), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n", -1)), runs), F.lit(0))


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and kept_text, for each row of docs."""
    hashes = materialise(line_hashes(docs, min_chars))
    common = materialise(common_lines(hashes, min_docs))
    lost = hashes.join(common, "h").where("doc_id IS NULL OR doc_id <> keeper")
    gone = materialise(lost.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_set("at")).alias("gone")))
    rows = _marked(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    n_lines = (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1).cast("long")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone")))
    return rows.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, place, line, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
