"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches.  A batch is reduced to one sorted *run*: a row per line hash with the number of documents
holding the line and the largest document id among them.  Runs live on levels; ``fanout`` runs of one level are
compacted into one run of the next, so a hash is rewritten a logarithmic number of times.  A later batch is
merge-joined against the runs, and its own lines are removed where the runs hold them, before its run is added.

``dedup_lines`` adds every batch first and then joins each line with the compacted runs, so the decision covers all
documents; ``LineRuns.admit`` is the incremental form, where only earlier batches count.

Edge cases: a null or empty text is one empty line.  Lines shorter than ``min_chars`` code points (after stripping)
always stay.  Rows of one doc_id count as one document, whatever their texts, and each row loses its own lines; rows
without doc_id count as one document below every other.  An empty table gives no rows.  Extra columns pass through; added columns get trailing
underscores where the table already has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeflow.llm.common import ASCII_SPACE, LOWER, UPPER, free_name, save, text_or_empty

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 4
RUN = "_h1 long, _h2 long, _docs long, _last long"


def lines_of(text: str = "text") -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def hashed_lines(docs: DataFrame, min_chars: int, batches: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per line that can be dropped: document, position in it, 128-bit hash of the key, batch of the document."""
    row = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text_or_empty(text)).alias("_text"), F.posexplode(lines_of(text)).alias("_pos", "_line"))
    keyed = row.select("_doc", "_text", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return keyed.select("_doc", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"),
                        F.pmod(F.xxhash64("_doc"), F.lit(batches)).cast("int").alias("_batch"))


def _merged(runs: list[DataFrame]) -> DataFrame:
    """One row per hash over several runs."""
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    if len(runs) == 1:
        return both
    return both.groupBy("_h1", "_h2").agg(F.sum("_docs").alias("_docs"), F.max("_last").alias("_last"))


class LineRuns:
    """The levels.  Each run is a written table sorted by hash; nothing of it is kept on the driver but its plan."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Adds the run of a batch (``hashed_lines`` rows) and compacts every level that is full."""
        once = lines.select("_h1", "_h2", "_doc").distinct()
        run = once.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_doc").cast("long").alias("_last"))
        self._put(run, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(save(run.sortWithinPartitions("_h1", "_h2"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(_merged(full), level + 1)

    def admit(self, lines: DataFrame) -> DataFrame:
        """The lines whose hash no run holds (a merge anti join against each run); then adds the batch."""
        fresh = lines
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), ["_h1", "_h2"], "left_anti")
        fresh = save(fresh, "fresh-lines")
        self.add(lines)
        return fresh

    def compacted(self) -> DataFrame:
        return _merged(self.runs())


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                fanout: int = FANOUT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines everywhere
    but in the document with the largest id.
    """
    n_lines, n_dropped = free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns)
    lines = save(hashed_lines(docs, min_chars, batches, text, doc_id), "lines", ["_batch"])
    store = LineRuns(fanout)
    for b in range(batches):
        store.add(lines.where(F.col("_batch") == b))
    common = save(store.compacted().where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_last"), "common-lines")
    hits = lines.join(common, ["_h1", "_h2"]).where(~F.col("_doc").eqNullSafe(F.col("_last")))
    drops = hits.groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))
    joined = docs.withColumn("_text", F.xxhash64(text_or_empty(text))).join(
        drops.withColumnRenamed("_text", "_text2"),
        F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_text2")), "left")
    every, drop = lines_of(text), F.coalesce(F.col("_drop"), F.array().cast("array<int>"))
    stretches = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1)).alias("a"),
                             F.concat(drop, F.array(F.size(F.col("_lines")))).alias("b"))
    kept = F.flatten(F.transform(stretches, lambda s: F.slice(F.col("_lines"), s["a"] + 1, s["b"] - s["a"])))
    whole = joined.withColumn("_lines", every)
    rest = [F.col(c) for c in docs.columns if c != text]
    new_text = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text)
    out = whole.select(*rest, new_text, F.size("_lines").cast("long").alias(n_lines), F.size(drop).cast("long").alias(n_dropped))
    return out.select(*docs.columns, n_lines, n_dropped)
