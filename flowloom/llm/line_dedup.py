"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines are hashed; in each window of ``min_lines`` lines the least hash (the leftmost, if tied) is a fingerprint, so any run
of ``min_lines`` equal lines shares one. Fingerprints that occur twice or more bring their positions together; from a
fingerprint a match extends both ways over the windows it stands for, whose lines must be equal in order. Of equal windows
the earliest stays: smaller ``doc_id``, then earlier line. Later windows of one source that continue each other form a run,
and runs are deleted. So a line goes if a run of ``min_lines`` or more lines that also starts earlier covers it; all runs
are judged on the input.

With ``min_words`` or ``min_chars`` a run of fewer lines counts as well if it has so many words or characters: windows of one
line up to ``min_lines - 1`` lines that reach one of them are taken beside those of ``min_lines``, and each size is matched by itself.

Groupings are partially aggregated before their shuffle and positions are joined, never collected by fingerprint, so a run
that very many documents share stays spread.

Lines end at ``\\n``; a document's last line may be empty. Null text stays null. Rows with null ``doc_id`` have no place in
the order and stay as they are. Rows that share a ``doc_id`` are ordered by a hash of their text, and equal rows are one
place. Other columns pass through, ``n_chars`` is recounted where it exists. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import new_name, stored


def _windows(w: int, least, weights: bool):
    """Windows of ``w`` lines of the array ``h``; with ``weights`` only those that reach one of ``least`` (column, number)."""
    starts = F.when(F.size("h") >= w, F.sequence(F.lit(1), F.size("h") - (w - 1))).otherwise(F.array().cast("array<int>"))
    if weights:
        def reaches(p):
            sums = [F.aggregate(F.slice(c, p, w), F.lit(0), lambda s, x: s + x) >= n for c, n in least]
            return sums[0] if len(sums) == 1 else sums[0] | sums[1]
        starts = F.filter(starts, reaches)
    return F.transform(starts, lambda p: F.struct(F.lit(w).alias("size"), p.alias("start"), F.array_min(F.slice("h", p, w)).alias("least"),
                                                  F.xxhash64(F.slice("h", p, w)).alias("same")))


def repeated_runs(docs: DataFrame, min_lines: int = 3, min_words: int | None = None, min_chars: int | None = None) -> DataFrame:
    """(doc_id, tag, start, length, src_doc, src_start): runs of lines to delete, with the place where they start earlier."""
    w = min_lines
    lines = F.split("text", "\n", -1)
    least = [(c, n) for c, n in (("words", min_words), ("chars", min_chars)) if n is not None]
    weigh = {"words": lambda x: F.regexp_count(x, F.lit(r"\S+")), "chars": F.length}
    known = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id"), F.xxhash64("text").alias("tag"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"),
        *[F.transform(lines, weigh[c]).alias(c) for c, _ in least])
    window = F.concat(*[_windows(v, least, v < w) for v in range(1 if least else w, w + 1)])
    placed = known.select("doc_id", "tag", "h", F.explode(window).alias("x"))
    spot = F.col("x.start") + F.array_position(F.slice("h", F.col("x.start"), F.col("x.size")), F.col("x.least")) - 1
    windows = stored(placed.select("doc_id", "tag", F.col("x.size").alias("size"), F.col("x.start").alias("start"), F.col("x.least").alias("mark"),
                                   spot.alias("spot"), F.col("x.same").alias("same")))
    prints = windows.select("mark", "doc_id", "tag", "spot").distinct()
    twice = prints.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    met = windows.join(twice, "mark")
    keys = ["mark", "size", "same"]
    first = met.groupBy(*keys).agg(F.min(F.struct("doc_id", "tag", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (met.join(first, keys).where("f.doc_id <> doc_id or f.tag <> tag or f.start <> start")
             .select("doc_id", "tag", "size", "start", F.col("f.doc_id").alias("src_doc"), F.col("f.tag").alias("src_tag"), F.col("f.start").alias("src_start"))
             .distinct())
    shift = F.col("src_start") - F.col("start")
    along = Window.partitionBy("doc_id", "tag", "size", "src_doc", "src_tag", shift).orderBy("start")
    gap = F.when(F.col("start") - F.lag("start").over(along) == 1, 0).otherwise(1)
    return (later.withColumn("gap", gap).withColumn("run", F.sum("gap").over(along))
            .groupBy("doc_id", "tag", "size", "src_doc", "src_tag", shift.alias("shift"), "run")
            .agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + F.col("size")).alias("length"))
            .select("doc_id", "tag", "start", "length", "src_doc", (F.col("start") + F.col("shift")).alias("src_start")))


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int | None = None, min_chars: int | None = None, counts: bool = True) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted; with ``counts`` also (n_lines, n_removed) before and by it, in place of columns of these names."""
    runs = repeated_runs(docs.select("doc_id", "text"), min_lines, min_words, min_chars)
    mark = new_name(docs)
    tag, of, doc, cut, line, gone = (mark + x for x in ("tag", "of", "doc", "cuts", "lines", "gone"))
    cuts = runs.groupBy(F.col("doc_id").alias(doc), F.col("tag").alias(of)).agg(F.collect_set(F.struct("start", "length")).alias(cut))
    base = docs.withColumn(tag, F.xxhash64("text"))
    met = base.join(cuts, (F.col("doc_id") == F.col(doc)) & (F.col(tag) == F.col(of)), "left")
    numbers = F.array_distinct(F.flatten(F.transform(cut, lambda c: F.sequence(c["start"].cast("long"), (c["start"] + c["length"] - 1).cast("long")))))
    met = met.withColumn(line, F.split("text", "\n", -1)).withColumn(gone, numbers)
    keep = F.array_except(F.sequence(F.lit(1).cast("long"), F.size(line).cast("long")), F.col(gone))
    kept = F.array_join(F.transform(keep, lambda i: F.element_at(line, i.cast("int"))), "\n")
    new = {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(line)).cast("long")
        new |= {"n_lines": n_lines, "n_removed": F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long")}
    own = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    return met.select(*(new.get(c, F.col(c)).alias(c) for c in own), *(new[c].alias(c) for c in ("n_lines", "n_removed") if counts))
