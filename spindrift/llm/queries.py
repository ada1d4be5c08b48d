"""Queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontam, langid, linededup, merkle, mixture, pii, simhash, suffixes, tokenfile, turntrie, vectors, wrapper
from spindrift.llm.common import table


def _tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_cosine_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"), length=50)


def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later repeated runs of three or more lines, or of 50 or more words, go."""
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_lines=3, min_words=50)
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from an altered leaf where 5 divides the crc32 of doc_id."""
    docs = table(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    return merkle.verified(merkle.manifest(docs, altered))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture.planned(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii_bilstm_crf": op2_pii_bilstm_crf,
    "op3_token_files": op3_token_files,
    "op4_bpe_transducer": op4_bpe_transducer,
    "op5_cosine_tiles": op5_cosine_tiles,
    "op6_suffix_array": op6_suffix_array,
    "op7_wrapper": op7_wrapper,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_line_dedup": op10_line_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mix": op13_source_mix,
    "pipeline": pipeline,
}


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}"


ORACLES: dict[str, str] = {
    # Every alignment of every document and item, by all equal words.
    "op1_decontaminate": f"""
        WITH d AS ({_words('documents', 'doc_id')}), b AS (SELECT min(item_id) AS item_id, w FROM ({_words('benchmark', 'item_id')}) GROUP BY w HAVING len(w) > 0),
        dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
        bw AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM b),
        same AS (SELECT doc_id, item_id, n, dw.p - bw.p AS shift, bw.p AS k FROM dw JOIN bw USING (w)),
        near AS (SELECT doc_id, item_id, shift FROM same GROUP BY ALL HAVING count(*) >= least(max(n), 13) - floor(2 * least(max(n), 13) / 13)),
        run AS (
            SELECT doc_id, item_id, least(n, 13) AS length, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n_same
            FROM same JOIN near USING (doc_id, item_id, shift)),
        found AS (SELECT doc_id, item_id, max(n_same) AS n_same FROM run WHERE n_same >= length - floor(2 * length / 13) GROUP BY ALL),
        by_doc AS (SELECT doc_id, count(*) AS n_items, max(n_same) AS n_same FROM found GROUP BY doc_id)
        SELECT documents.doc_id, by_doc.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(n_same, 0) AS n_same
        FROM documents LEFT JOIN by_doc USING (doc_id)""",
    "op10_line_dedup": """
        WITH line AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        filled AS (SELECT doc_id, i, trim(t) AS t, len(regexp_split_to_array(trim(t), '[ \\t\\r]+')) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM line WHERE trim(t) <> ''),
        run AS (
            SELECT doc_id, p, unnest([1, 2, 3]) AS n, unnest([
                CASE WHEN c >= 50 THEN t END, CASE WHEN c + lead(c, 1) OVER w >= 50 THEN t || chr(10) || lead(t, 1) OVER w END,
                t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w]) AS r, CAST(doc_id AS HUGEINT) * 1000000000 + p AS place
            FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        once AS (SELECT n, r, min(place) AS place FROM run WHERE r IS NOT NULL GROUP BY n, r),
        later AS (
            SELECT run.doc_id, run.p, n FROM run JOIN once USING (n, r)
            WHERE once.place // 1000000000 < run.doc_id OR once.place + n <= run.place),
        gone AS (SELECT DISTINCT f.doc_id, f.i FROM later JOIN filled f ON f.doc_id = later.doc_id AND f.p BETWEEN later.p AND later.p + later.n - 1),
        kept AS (
            SELECT l.doc_id, count(*) FILTER (trim(l.t) <> '') AS n_lines, count(g.i) AS n_removed,
                   string_agg(l.t, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
            FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               CAST(length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END) AS BIGINT) AS n_kept_chars,
               sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END) AS kept_sha256
        FROM documents d LEFT JOIN kept USING (doc_id)""",
    # All pairs, and all that links reach.
    "op5_cosine_tiles": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
        link AS (SELECT a.vec_id, b.vec_id AS other FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_dot_product(a.u, b.u) >= 0.95),
        reach AS (SELECT vec_id, other FROM link UNION SELECT reach.vec_id, link.other FROM reach JOIN link ON link.vec_id = reach.other),
        n AS (SELECT vec_id, count(*) AS n_links FROM link GROUP BY 1), r AS (SELECT vec_id, min(other) AS least FROM reach GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN r USING (vec_id)""",
    # Every string of 50 bytes, as hexadecimal digits.
    "op6_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
        hit AS (SELECT doc_id, i, CAST(i > lag(i, 1, i - 51) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS INT) AS fresh FROM w JOIN f USING (s) WHERE first < doc_id),
        run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
        part AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM run),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS k, max(z) AS z, sum(z - a) AS n_removed, count(*) AS n_spans FROM part JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}


def _crc32(digits: str) -> str:
    """The unsigned crc32 of a text of ASCII characters, bit by bit."""
    bits = f"flatten(list_transform(list_filter(string_split({digits}, ''), lambda x: x <> ''), lambda x: list_transform(range(8), lambda i: (ascii(x) >> i) & 1)))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


#: White space as the contracts have it, in a regular expression.
_FILLED = r"[^\x20\x09-\x0D]+"

ORACLES["op11_prefix_trie"] = f"""
    WITH given AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list([role, text] ORDER BY p) AS turns, {_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM given GROUP BY conv_id),
    conv AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
    member AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM conv),
    prefix AS (SELECT conv_id, n, depth, turns[1:depth] AS turns FROM member),
    node AS (SELECT depth, turns, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM prefix GROUP BY depth, turns),
    linked AS (
        SELECT c.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node x WHERE x.depth = c.depth + 1 AND x.turns[1:c.depth] = c.turns) AS n_children,
               CASE WHEN c.depth > 0 THEN (c.n_convs - 1) * len(regexp_extract_all(c.turns[c.depth][2], '{_FILLED}')) ELSE 0 END AS saved
        FROM node c LEFT JOIN node p ON p.depth = c.depth - 1 AND p.turns = c.turns[1:c.depth - 1])
    SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children, CAST(sum(CAST(b.n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves,
           CAST(sum(b.saved) AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
    FROM linked a JOIN linked b ON b.depth >= a.depth AND b.turns[1:a.depth] = a.turns
    GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends"""


def _merkle_sql() -> str:
    """Six levels in a source (16 million documents), four over the sources (65 536), written out one by one; a tree that is one node stays as it is."""
    low, high = 6, 4
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.FIELDS) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [f"""leaf AS (SELECT doc_id, source, {fields('text')} AS d, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {fields(lower)} END AS altered FROM documents),
        s0 AS (SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, doc_id, d, altered FROM leaf)"""]

    def up(a: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"{a}r{k} AS (SELECT key, i // 16 AS r, any_value(n) AS n, string_agg(d, '' ORDER BY i) AS all_d FROM {a}{k} GROUP BY key, i // 16)")
            parts.append(f"{a}{k + 1} AS (SELECT key, r AS i, CASE WHEN n > 1 THEN sha256(all_d) ELSE all_d END AS d, count(*) OVER (PARTITION BY key) AS n FROM {a}r{k})")

    up("s", low)
    parts.append(f"t0 AS (SELECT 0 AS key, key - 1 AS i, count(*) OVER () AS n, d FROM s{low})")
    up("t", high)
    parts.append(f"f0 AS (SELECT s0.doc_id, s0.key, s0.i AS place, s0.d AS leaf, s{low}.d AS subroot, t{high}.d AS root, '' AS proof, coalesce(altered, s0.d) AS folded FROM s0 JOIN s{low} USING (key) CROSS JOIN t{high})")
    step = 0
    for a, levels in (("s", low), ("t", high)):
        for k in range(levels):
            at = f"(place // {16**k})" if a == "s" else f"((f{step}.key - 1) // {16**k})"
            run, others, left, right = f"{a}r{k}", f"CASE WHEN n > 1 THEN {{}} ELSE '' END", f"substr(all_d, 1, 64 * ({at} % 16))", f"substr(all_d, 64 * ({at} % 16) + 65)"
            parts.append(f"f{step + 1} AS (SELECT f{step}.* REPLACE (proof || {others.format(left + ' || ' + right)} AS proof, CASE WHEN n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded) FROM f{step} JOIN {run} ON {run}.r = {at} // 16 AND {run}.key = " + (f"f{step}.key" if a == "s" else "0") + ")")
            step += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{step}"


ORACLES["op12_merkle_manifest"] = _merkle_sql()

# The share of a weight is the largest that leaving out the sources with the least room for their weight gives.
ORACLES["op13_source_mix"] = f"""
    WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_FILLED}')), 0) AS BIGINT) AS size FROM documents),
    ranked AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
    prior AS (SELECT *, coalesce(sum(3 * s) OVER o, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS held, sum(s) OVER () AS total
              FROM ranked WINDOW o AS (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    share AS (SELECT arg_max(total - capped, (total - capped) / held) AS over, arg_max(held, (total - capped) / held) AS held FROM prior),
    target AS (SELECT source, CAST(s AS BIGINT) AS source_size, CASE WHEN w * over > 3 * s * held THEN CAST(3 * s AS DOUBLE) ELSE CAST(w * over AS DOUBLE) / CAST(held AS DOUBLE) END AS target FROM ranked, share),
    rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM target)
    SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CAST(
        CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) AS BIGINT) AS BIGINT) AS taken
    FROM sized JOIN rate ON sized.source IS NOT DISTINCT FROM rate.source"""
