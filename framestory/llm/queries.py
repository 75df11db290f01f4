"""The text operators applied to the given tables, one thin step each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestory.llm import credentials, gallery, language, licenses, lines, merkle, mixing, packing, pigeonhole, simhash, tokens, toxicity, trie, whitening
from framestory.llm.common import ranked
from framestory.sources.fixtures import Inputs

#: Fixed value: a run of anything but blanks and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
CATEGORIES = ["low_quality", "toxic", "severe"]


def op1_secret_scan(t: Inputs) -> DataFrame:
    found = credentials.scan_secrets(t.table("documents"), key="doc_id", text="text")
    base, kinds = [r.kind for r in credentials.RULES if r.base], [r.kind for r in credentials.RULES]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(credentials.span_list(base), 256).alias("base_sha256"), credentials.span_list(kinds).alias("spans"))


def op2_license_scan(t: Inputs) -> DataFrame:
    m = licenses.license_matches(t.table("documents"), key="doc_id", text="text")
    return m.select("doc_id", "n_words", F.col("n_phrases").alias("n_base"), "first_word", "last_word",
                    F.array_join("phrase_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def op3_mix_sources(t: Inputs) -> DataFrame:
    m = mixing.mix_domains(document_sizes(t.table("documents")), key="doc_id", domain="source", frames="size")
    return m.select("doc_id", "size", F.col("domain_size").alias("source_size"), "target", "taken", F.col("source_domain").alias("source"))


def op4_fingerprints(t: Inputs) -> DataFrame:
    m = merkle.fingerprint_briefs(t.table("documents"), key="doc_id", text="text")
    return m.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                    F.col("edited_at.section").cast("long").alias("edited_section"), F.col("edited_at.paragraph").cast("long").alias("edited_paragraph"))


def op5_topk(t: Inputs) -> DataFrame:
    v = t.table("embeddings")
    return gallery.gallery_topk(v, v.where("vec_id % 50 = 0"), 5, key="vec_id", embedding="embedding", scale=256)


def toxicity_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic", ((1 - F.col("quality")) * F.col("toxic")).alias("severe"))


def op6_toxicity(t: Inputs) -> DataFrame:
    return toxicity.toxic_notes(t.table("documents"), toxicity_labels(t.table("labels")), CATEGORIES, "toxic", key="doc_id", text="text")


def op7_simhash(t: Inputs) -> DataFrame:
    m = simhash.near_failures(t.table("documents"), key="doc_id", text="text", words=3, bits=64, max_bits=2)
    return m.select("doc_id", "fingerprint", F.col("component").alias("component_id"))


def op8_line_dedup(t: Inputs) -> DataFrame:
    m = lines.line_classes(t.table("documents"), key="doc_id", text="text")
    return m.select("doc_id", "line_no", "n_chars", F.col("class_key").alias("class_doc"), "class_line", "kept")


def op9_language(t: Inputs) -> DataFrame:
    docs = t.table("documents")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    model = language.fit_language(docs.where(F.col("doc_id").isNotNull() & ~held_out), text="text", lang="lang", key="doc_id")
    return language.note_languages(docs, model, key="doc_id", text="text").select("doc_id", held_out, "lang_pred", "score")


def op10_packing(t: Inputs) -> DataFrame:
    import public_tokenizers

    pieces = tokens.token_pieces(t.table("documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, key="doc_id", text="text")
    return packing.pack_clips(pieces, length="length", capacity=2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("reel_id").alias("sequence_id"), "offset")


def op11_jaccard_join(t: Inputs) -> DataFrame:
    m = pigeonhole.similar_briefs(t.table("documents"), key="doc_id", text="text", words=3, percent=90)
    return m.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Turns of every conversation c, the first h of them taken from conversation c - c % 100; ``place`` keeps their order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    c = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", text("role"), text("text"))
    c = ranked(c, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    first = c.groupBy(F.col("conv_id").alias("_c")).agg(F.min("seq").alias("_from")).withColumn("_h", F.crc32(F.col("_c").cast("string")) % 6)
    d = c.join(first, F.col("conv_id") == F.col("_c")).withColumn("place", F.col("seq") - F.col("_from"))
    own = d.where("place >= _h").select("conv_id", "place", "role", "text")
    heads = d.where("place < 5").select(F.col("conv_id").alias("_base"), "place", "role", "text")
    taken = first.where("_h > 0").select("_c", "_h", (F.col("_c") - F.col("_c") % 100).alias("_b"))
    taken = taken.join(heads, (F.col("_b") == F.col("_base")) & (F.col("place") < F.col("_h")))
    return own.unionByName(taken.select(F.col("_c").alias("conv_id"), "place", "role", "text"))


def op12_prefix_trie(t: Inputs) -> DataFrame:
    c = t.table("conversations")
    m = trie.story_trie(rebuilt_turns(c), c, key="conv_id", place="place", kind="role", detail="text")
    return m.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n_segments").alias("n_convs"), "n_children",
                    "n_leaves", F.col("saved_chars").alias("saved_tokens"), "ends_sha256")


def op13_whitening(t: Inputs) -> DataFrame:
    return whitening.whiten_tracks(t.table("embeddings"), 8, key="vec_id", embedding="embedding")


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _secret_sql() -> str:
    hits, outs = [], []
    for i, r in enumerate(credentials.RULES):
        p = _quoted(r.pattern)
        value = f"regexp_extract(h[i], '{p}', {r.group})" if r.group else "h[i]"
        hits.append(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, h, s, i, {value} AS v, {r.least} AS least FROM "
                    f"(SELECT doc_id, h, s, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS s FROM d))")
    outs = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in credentials.RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(hits)}),
p AS (SELECT doc_id, k, kind, base, length(h[i]) AS n,
      list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS a FROM m WHERE length(v) >= least),
q AS (SELECT doc_id, k, kind, base, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b FROM p),
g AS (SELECT doc_id, {outs}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (base) AS bs,
      string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM q GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in credentials.RULES if r.base)},
       sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def _license_sql() -> str:
    words = lambda s: "[" + ", ".join(f"'{w}'" for w in s.split()) + "]"
    phrases = ", ".join(f"('{k}', {words(p)})" for k, p in licenses.PHRASES.items())
    templates = ", ".join(f"('{k}', {words(' '.join(dict.fromkeys(p.split())))})" for k, p in licenses.TEMPLATES.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, ws) AS (VALUES {phrases}), t(label, ws) AS (VALUES {templates}),
x AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i+1:i+len(ws)] = ws)) AS place FROM d, p),
b AS (SELECT doc_id, w[f+1:f+64] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), 32)) AS f FROM d)),
y AS (SELECT doc_id, label, max(len(list_intersect(ws, w)) / len(ws)) AS share FROM b, t GROUP BY ALL HAVING share >= 0.8 - 1e-12),
l AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM x UNION ALL SELECT doc_id, label, share FROM y),
gl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM l GROUP BY doc_id),
gx AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gx.n, 0) AS n_base, CAST(gx.a AS BIGINT) AS first_word, CAST(gx.z AS BIGINT) AS last_word,
       coalesce(gx.labels, '') AS base_labels, coalesce(gl.labels, '') AS labels, coalesce(gl.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN gx ON d.doc_id = gx.doc_id LEFT JOIN gl ON d.doc_id = gl.doc_id"""


def _merkle_sql() -> str:
    leaves = f"list_transform(regexp_extract_all(p, '(?s).{{1,{merkle.LEAF_CHARS}}}'), lambda x: sha256(x))"
    tree = lambda c: f"list_transform(string_split({c}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {leaves}))"
    up = lambda c: f"sha256(coalesce(list_aggregate({c}, 'string_agg', ''), ''))"
    branch = lambda c: f"list_transform({c}, lambda s: list_transform(s, lambda p: {up('p')}))"
    root = lambda c: up(f"list_transform({branch(c)}, lambda s: {up('s')})")
    flat = lambda c: f"list_distinct(flatten(flatten({c})))"
    like = lambda a, b, ra, rb: f"CASE WHEN {ra} = {rb} THEN 1.0::DOUBLE ELSE 2 * len(list_intersect({flat(a)}, {flat(b)})) / greatest(len({flat(a)}) + len({flat(b)}), 1) END"
    first = lambda a, b: f"list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i]), true)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, left(t, CAST(length(t) - length(t) // 4 AS BIGINT)) || left(nt, CAST(length(t) // 4 AS BIGINT)) AS et FROM n),
p AS (SELECT doc_id, length(t) AS n, et, {tree('t')} AS a, {tree('et')} AS b, {tree('nt')} AS c FROM e),
r AS (SELECT doc_id, n, et, a, b, c, {root('a')} AS ra, {root('b')} AS rb, {root('c')} AS rc, {branch('a')} AS ba, {branch('b')} AS bb FROM p),
s AS (SELECT *, {first('ba', 'bb')} AS sec FROM r)
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, ra AS fingerprint, rb AS edited_fingerprint,
       {like('a', 'b', 'ra', 'rb')} AS near_edited, {like('a', 'c', 'ra', 'rc')} AS near_next,
       CASE WHEN sec > 0 THEN CAST(sec - 1 AS BIGINT) END AS edited_section,
       CASE WHEN sec > 0 THEN CAST({first('coalesce(ba[sec], [])', 'coalesce(bb[sec], [])')} - 1 AS BIGINT) END AS edited_paragraph FROM s"""


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

#: crc32 of a decimal number, byte by byte and bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, y: xor(b >> 1, 3988292384::BIGINT * (b & 1)))))"""

TRIE_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
  coalesce(role, '') AS a, coalesce(text, '') AS b FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, {_CRC_SQL.format('c')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, a, b FROM (
  SELECT v.c, t.pos, t.a, t.b FROM v JOIN t ON t.c = v.c - v.c % 100 AND t.pos < v.h UNION ALL SELECT v.c, t.pos, t.a, t.b FROM v JOIN t USING (c) WHERE t.pos >= v.h)),
n(c, d, node, par, len) AS (
  SELECT c, 0::BIGINT, min(c) OVER (), NULL::BIGINT, 0::BIGINT FROM v
  UNION ALL SELECT r.c, r.d, min(r.c) OVER (PARTITION BY n.node, r.a, r.b), n.node, length(r.b) FROM n JOIN r ON r.c = n.c AND r.d = n.d + 1),
g AS (SELECT d, node, min(par) AS par, count(*) AS k, min(len) AS len FROM n GROUP BY d, node),
ch AS (SELECT d - 1 AS d, par AS node, count(*) AS k FROM g WHERE d > 0 GROUP BY ALL),
sub AS (SELECT n.d, n.node, sum((g.k - 1) * g.len) AS saved, count(*) FILTER (ch.k IS NULL) AS leaves
  FROM g LEFT JOIN ch USING (d, node) JOIN n ON n.c = g.node AND n.d <= g.d GROUP BY ALL),
e AS (SELECT d, node, string_agg(CAST(n.c AS VARCHAR), ',' ORDER BY n.c) AS ids FROM n JOIN (SELECT c, max(d) AS d FROM n GROUP BY c) m USING (c, d) GROUP BY ALL)
SELECT g.node AS conv_id, g.d AS depth, g.par AS parent_conv_id, g.k AS n_convs, coalesce(ch.k, 0) AS n_children, sub.leaves AS n_leaves,
  CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM g LEFT JOIN ch USING (d, node) JOIN sub USING (d, node) LEFT JOIN e USING (d, node)"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN 'doc ' || doc_id ELSE sha256(array_to_string(s, chr(10))) END AS v, s FROM s),
u AS (SELECT v, min(doc_id) AS least, any_value(n) AS n, any_value(s) AS s FROM k GROUP BY v),
g AS (SELECT v, n, hash(unnest(s)) AS g FROM u),
p AS (SELECT a.v AS a, b.v AS b FROM g a JOIN g b ON a.g = b.g AND a.v < b.v AND 90 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  GROUP BY a.v, b.v HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(v, r) AS (SELECT a, a FROM l UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.v),
m AS (SELECT c.v, min(u.least) AS least FROM c JOIN u ON u.v = c.r GROUP BY c.v)
SELECT doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.least, u.least) AS component_id FROM k JOIN u USING (v) LEFT JOIN m USING (v)"""

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_mix_sources, op4_fingerprints, op5_topk, op6_toxicity,
                                   op7_simhash, op8_line_dedup, op9_language, op10_packing, op11_jaccard_join, op12_prefix_trie, op13_whitening)}
ORACLES = {"op1_secret_scan": _secret_sql(), "op2_license_scan": _license_sql(), "op4_fingerprints": _merkle_sql(), "op5_topk": TOPK_SQL,
           "op11_jaccard_join": JACCARD_SQL, "op12_prefix_trie": TRIE_SQL}
