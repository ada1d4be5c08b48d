"""Line deduplication by winnowing, in DataFrame operations only.

A document is its sequence of lines that aren't blank, hashed once. Of every window of ``min_lines`` lines, and of every
shorter one of ``min_words`` words, the line of least hash (the first of equals) is selected: two equal runs of that size
select the same one, so that one row per selected line, its fingerprint, is guaranteed to meet them. Fingerprints of lines selected
at one place only go at once. The others are joined with the first place that holds the same line in the same surroundings, which are
the windows that selected it, and of these positions that lie on one diagonal (same two documents, same distance) the matches
are extended both ways from one to the next, as far as the lines agree: selected lines of a run are less than a window apart. What is
then covered by a match with an earlier place is deleted.

Fingerprints are sent once, by their line, with the windows that selected it. Lines that hold over a thousandth of them (or an
average partition) are under a thousand (or the number of partitions) and broadcast; their windows are reduced where they are, and
joined in two parts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import kept_table

#: Keys with more than the HOT-th part of all rows are broadcast; there are fewer than HOT of them.
HOT = 1000


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, h, g, c``: two hashes, of independent seeds, and the words of each line that isn't blank."""
    filled = docs.select("doc_id", F.expr("filter(transform(split(text, '\n'), x -> trim(x)), x -> x <> '')").alias("t"))
    hashes = [F.expr(e).alias(n) for e, n in (("transform(t, x -> xxhash64(x))", "h"), ("transform(t, x -> xxhash64(7, x))", "g"), ("transform(t, x -> size(split(x, '[ \\\\t\\\\r]+')))", "c"))]
    return filled.select("doc_id", *hashes).where("size(h) > 0")


def _fingerprints(lines: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """``doc_id, at, mark, windows``: each selected line, its hash, and the windows (``n, start, k1, k2``: lines, first line, hash of 128 bits) that selected it."""
    sizes = [min_lines] if min_words is None else list(range(1, min_lines + 1))
    least, around = [], []
    for n in sizes:
        picked = f"slice(h, s + 1, {n})"
        wordy = "" if n == min_lines else f" and aggregate(slice(c, s + 1, {n}), 0, (a, x) -> a + x) >= {min_words}"
        # For each first line: the selected line of the window, -1 if it is none.
        least.append(F.expr(f"transform(sequence(0, size(h) - 1), s -> if(s + {n} <= size(h){wordy}, s + cast(array_position({picked}, array_min({picked})) as int) - 1, -1))").alias(f"m{n}"))
        around.append(f"transform(filter(sequence(greatest(0, p - {n - 1}), p), s -> m{n}[s] = p), s -> struct({n} as n, s as start, xxhash64({picked}) as k1, xxhash64(7, slice(g, s + 1, {n})) as k2))")
    chosen = lines.select("doc_id", "h", "g", *least)
    made = F.expr(f"filter(transform(sequence(0, size(h) - 1), p -> struct(p as at, h[p] as mark, concat({', '.join(around)}) as windows)), f -> size(f.windows) > 0)")
    return chosen.select("doc_id", F.explode_outer(made).alias("f")).where("f is not null").select("doc_id", "f.at", "f.mark", "f.windows")


def _firsts(windows: DataFrame) -> DataFrame:
    """``windows`` that more than one place holds, with their ``first``; for lines so frequent that no task is to hold all their places."""
    first = F.struct("doc_id", "start")
    firsts = kept_table(windows.groupBy("n", "k1", "k2").agg(F.count("*").alias("rows"), F.min(first).alias("first"), F.max(first).alias("last")).where("first <> last").select("n", "k1", "k2", "rows", "first"), "line-firsts")
    on, many = ["n", "k1", "k2"], _many(firsts)
    hot = F.broadcast(firsts.where(F.col("rows") > many).drop("rows"))
    cool = firsts.where(F.col("rows") <= many).drop("rows")
    return windows.join(hot, on).unionByName(windows.join(hot.select(*on), on, "left_anti").join(cool, on))


def _many(keys: DataFrame) -> float:
    """The number of rows above which a key is hot: an average partition's, and no more than a HOT-th of all."""
    total = keys.agg(F.sum("rows").alias("n")).first()["n"] or 0
    return total / max(HOT, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def repeated(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``doc_id, runs``: first lines (among those not blank, from 0) and ends of the runs that an earlier place holds too.

    A run has ``min_lines`` lines or, with ``min_words``, so many words at least. Within a document an earlier place counts only
    if its window doesn't overlap with the later one.
    """
    lines = kept_table(_lines(docs), "lines")
    prints = kept_table(_fingerprints(lines, min_lines, min_words), "line-prints")
    marks = kept_table(prints.groupBy("mark").agg(F.count("*").alias("rows")).where("rows > 1"), "line-marks")
    hot = F.broadcast(marks.where(F.col("rows") > _many(marks)).select("mark"))
    opened = lambda some: some.select("doc_id", "mark", F.explode_outer("windows").alias("w")).select("doc_id", "mark", "w.*")
    # Equal windows have selected equal lines: the fingerprints are sent once, by their line, and all is compared where they arrive.
    at, first = Window.partitionBy("mark"), F.struct("doc_id", "start")
    cool = prints.join(hot, "mark", "left_anti").withColumn("places", F.count("*").over(at)).where("places > 1").drop("places")
    same = Window.partitionBy("mark", "n", "k1", "k2")
    cool = opened(cool).withColumn("first", F.min(first).over(same)).drop("mark", "k1", "k2")
    met = cool.unionByName(_firsts(opened(prints.join(hot, "mark", "left_semi")).drop("mark")).drop("k1", "k2"))
    later = met.where("first.doc_id < doc_id or (first.doc_id = doc_id and first.start + n <= start)")
    # The matches of a diagonal, extended to both sides: windows in order, joined to runs while the next begins within or at the end.
    on = later.groupBy("doc_id", F.col("first.doc_id").alias("partner"), (F.col("start") - F.col("first.start")).alias("shift")).agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("ws"))
    runs = F.expr("""aggregate(ws, cast(array() as array<struct<start: int, end: int>>), (a, w) ->
        if(size(a) > 0 and w.start <= element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, w.end) as end))),
           concat(a, array(w))))""")
    return on.select("doc_id", runs.alias("runs")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs of ``min_lines`` or more lines, or of ``min_words`` or more words, deleted from ``text``.

    All columns stay, in order, and ``n_lines`` (not blank) and ``n_removed`` follow, longs.
    Lines are compared by 128 bits of hash, without spaces at their ends; blank lines are passed over in
    comparing and stay. The first place of each line in the whole table always stays,
    so text is never lost everywhere. Null texts stay null, and empty ones empty, with 0 lines;
    rows of one doc_id count as one document. An empty table stays empty.
    """
    found = repeated(docs.select("doc_id", "text"), min_lines, min_words).withColumnsRenamed({"doc_id": "_dd_id", "runs": "_dd_runs"})
    joined = docs.join(found, docs["doc_id"] == F.col("_dd_id"), "left")
    lines = "split(text, '\n')"
    filled = f"filter(transform({lines}, (x, i) -> if(trim(x) <> '', i, -1)), i -> i >= 0)"
    staged = joined.withColumn("_dd_filled", F.expr(f"if(text is null, cast(array() as array<int>), {filled})")).withColumn("_dd_gone", F.expr("if(_dd_runs is null, cast(array() as array<int>), array_distinct(flatten(transform(_dd_runs, r -> slice(_dd_filled, r.start + 1, r.end - r.start)))))"))
    text = F.expr(f"if(size(_dd_gone) = 0, text, array_join(transform(array_except(sequence(0, size({lines}) - 1), _dd_gone), i -> element_at({lines}, i + 1)), '\n'))")
    out = staged.withColumn("_dd_text", text)
    return out.select(*[(F.col("_dd_text").alias("text") if c == "text" else docs[c]) for c in docs.columns], F.size("_dd_filled").cast("long").alias("n_lines"), F.size("_dd_gone").cast("long").alias("n_removed"))
