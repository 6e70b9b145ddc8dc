"""The queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hmm, lattice, licenses, lines, packing, periodic, secrets, simhash, toxicity, trie, warc
from .common import new_path, written


#: Score from which a document counts as toxic.
TOXIC_AT = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    ends = warc.read(spark, path).where("last")
    return ends.select(F.col("record_id").cast("long").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, removed_col="lines_removed")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(written(chat.format_conversations(turns), "conversations"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n: how queries hold documents out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3, "_id") != 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), new_path(spark, "blob-ledger")
    # Two increments of one history: the first has half of the documents; the second has all, and scans what is new.
    secrets.scan(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0), "doc_id", "text", ledger)
    found = secrets.scan(docs, "doc_id", "text", ledger)
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind_no"] == n)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return found.select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.shared_openings(trie.numbered(table(spark, sf_dir, "conversations"))))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic.find_runs(table(spark, sf_dir, "documents").select("doc_id", periodic.with_repeats(F.col("text"), h).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), (-longest["less"]).alias("length"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(F.col("id").alias("doc_id"), "n_runs", "r.start", "length", "r.period", F.floor(1000 * F.col("length") / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_warc": op2_warc,
    "op3_lines": op3_lines,
    "op4_chat": op4_chat,
    "op5_lattice": op5_lattice,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_hmm": op9_hmm,
    "op10_secrets": op10_secrets,
    "op11_trie": op11_trie,
    "op12_periodic": op12_periodic,
    "op13_licenses": op13_licenses,
}

def crc32_sql(x: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an expression as text of ASCII characters."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: {step})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda crc, b: {byte}))"


def templates_sql() -> str:
    """Rows (t, label, phrase, need, words, tokens) of the license templates for DuckDB."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    return ", ".join(f"({n}, '{t.label}', {t.phrase}, {t.need}, {listed(t.words)}, {listed(t.tokens)})" for n, t in enumerate((*licenses.PHRASES, *licenses.TEMPLATES)))


#: Where SQL can express an operator. Fingerprints, learned models and packing plans it can't; tests compare them with plain versions.
ORACLES: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM f""",
    "op4_chat": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length('### ' || role || ': ' || text || '</turn>') + 1 + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
    "op5_lattice": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id""",
    "op10_secrets": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules AS (SELECT * FROM (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '[A-Za-z0-9+/_.=-]+', 6), (1, 'access', '', 'AKIA[A-Z0-9]+', 20), (2, 'hex', '', '[0-9a-f]+', 24)) AS x(no, kind, head, body, least)),
m AS (SELECT doc_id, no, kind, least, unnest(CASE no WHEN 0 THEN regexp_extract_all(t, '(?s).*?(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') WHEN 1 THEN regexp_extract_all(t, '(?s).*?AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '(?s).*?[0-9a-f]+') END) AS s,
  unnest(CASE no WHEN 0 THEN regexp_extract_all(t, '(?s).*?((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', 1) WHEN 1 THEN regexp_extract_all(t, '(?s).*?(AKIA[A-Z0-9]+)', 1) ELSE regexp_extract_all(t, '(?s).*?([0-9a-f]+)', 1) END) AS w,
  unnest(CASE no WHEN 0 THEN regexp_extract_all(t, '(?s).*?(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) WHEN 1 THEN regexp_extract_all(t, '(?s).*?(AKIA[A-Z0-9]+)', 1) ELSE regexp_extract_all(t, '(?s).*?([0-9a-f]+)', 1) END) AS g,
  unnest(range(len(CASE no WHEN 0 THEN regexp_extract_all(t, '(?s).*?(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') WHEN 1 THEN regexp_extract_all(t, '(?s).*?AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '(?s).*?[0-9a-f]+') END))) AS i FROM d, rules),
e AS (SELECT *, CAST(sum(length(s)) OVER (PARTITION BY doc_id, no ORDER BY i) AS BIGINT) AS fin FROM m), k AS (SELECT *, fin - length(w) AS start FROM e WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, no) AS spans FROM k GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)""",
    "op11_trie": rf"""WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, {crc32_sql('c')} % 4 AS h FROM (SELECT DISTINCT c FROM o)),
b AS (SELECT k.c, i, r, t FROM k JOIN o ON o.c = k.c - k.c % 20 AND i < h UNION ALL SELECT k.c, i, r, t FROM k JOIN o ON o.c = k.c AND i >= h),
l AS (SELECT c, list(sha256(length(r) || ':' || r || t) ORDER BY i) AS p, list(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) ORDER BY i) AS w FROM b GROUP BY c),
a AS (SELECT c, coalesce(p, []) AS p, coalesce(w, []) AS w FROM k LEFT JOIN l USING (c)), e AS (SELECT *, unnest(range(len(p) + 1)) AS d FROM a),
m AS (SELECT c, d, p[1:d] AS node, CASE WHEN d > 0 THEN list_slice(p, 1, d - 1) END AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, len(p) = d AS fin FROM e),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, any_value(up) AS up, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (fin), '')) AS ends_sha256 FROM m GROUP BY node, d),
h AS (SELECT up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up), f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN h USING (node)),
s AS (SELECT m.node, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.w) AS BIGINT) AS saved_tokens FROM f JOIN m ON m.c = f.conv_id AND m.d <= f.d GROUP BY m.node)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM f JOIN s USING (node) LEFT JOIN f u ON u.node = f.up""",
    "op12_periodic": rf"""WITH o AS (SELECT doc_id, {crc32_sql('doc_id')} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT *, h // 10 AS g, len(w) AS n FROM o), a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT)]) ELSE w END AS w FROM p),
t AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM d), b AS (SELECT doc_id, n, w, list(i ORDER BY i) AS ps FROM t GROUP BY ALL HAVING len(ps) > 3),
c AS (SELECT doc_id, n, unnest(ps) AS i, ps FROM b), e AS (SELECT doc_id, i, unnest(list_filter(ps, lambda j: j > i AND j - i <= n // 4)) - i AS q FROM c),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
m AS (SELECT doc_id, q, min(i) AS a, count(*) + q AS l FROM s GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM m WHERE NOT EXISTS (FROM m AS x WHERE x.doc_id = m.doc_id AND x.q < m.q AND x.a <= m.a AND x.a + x.l >= m.a + m.l)),
z AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(a, l, q), struct_pack(x := -l, a, q)) AS b, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) AS runs FROM r GROUP BY doc_id),
f AS (SELECT t.doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.a + r.q AND t.i < r.a + r.l) GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.a AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN z USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op13_licenses": rf"""WITH r AS (FROM (VALUES {templates_sql()}) AS x(t, label, phrase, need, words, tokens)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w))) AS i, len(w) AS n FROM d), p AS (SELECT doc_id, i, w[i + 1] AS word FROM i), v AS (SELECT t, need, label, phrase, len(tokens) AS n, unnest(tokens) AS word FROM r),
h AS (SELECT doc_id, i // 32 AS b, p.word, t, need, label, n FROM p JOIN v USING (word) WHERE NOT phrase UNION ALL SELECT doc_id, i // 32 - 1, p.word, t, need, label, n FROM p JOIN v USING (word) WHERE NOT phrase AND i >= 32),
m AS (SELECT doc_id, label, count(DISTINCT word) / n AS share FROM h GROUP BY doc_id, b, t, need, label, n HAVING count(DISTINCT word) >= need),
s AS (SELECT doc_id, i, label FROM i JOIN r ON phrase AND w[i + 1] = words[1] AND list_slice(w, i + 1, i + len(words)) = words),
c AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM s GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, share FROM m UNION ALL SELECT doc_id, label, 1.0 FROM s) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)""",
}
