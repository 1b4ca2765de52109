"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.llm.common import table
from gaugeline.llm.urlfilter import BLOCKED_HOSTS, PARKED


def op1_quality(spark, sf_dir):
    """Base rules and likelihood ratio of all documents; trusted are those labelled of quality 1."""
    from gaugeline.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, sf_dir, "labels").filter("quality = 1"))
    return quality.judge(docs, weights).drop("text")


def op2_syncmers(spark, sf_dir):
    """Closed-syncmer fingerprints of all documents and their edited texts."""
    from gaugeline.llm import syncmers

    return syncmers.with_edits(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    """Systematic sampling of all documents to the contract's targets."""
    from gaugeline.llm import mixing

    sizes = mixing.sizes_table(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.mix(sizes, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_packing(spark, sf_dir):
    """Best-fit decreasing packing of all documents."""
    from gaugeline.llm import packing

    return packing.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_simhash(spark, sf_dir):
    """SimHash components of all documents."""
    from gaugeline.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_lines(spark, sf_dir):
    """The text of all documents without passages that repeat across them."""
    from gaugeline.llm import lines

    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secrets(spark, sf_dir):
    """Secrets in all documents."""
    from gaugeline.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.train(docs))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.written_spans(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), base, secrets.written_spans(F.col("spans")).alias("spans"))


def op8_pii(spark, sf_dir):
    """Personal data in all documents."""
    from gaugeline.llm import pii

    found = pii.find(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, pii.KINDS), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_urlfilter(spark, sf_dir):
    """A verdict on every url of pages."""
    from gaugeline.llm import urlfilter

    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_classifier(spark, sf_dir):
    """The quality score of all documents."""
    from gaugeline.llm import rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_importance(spark, sf_dir):
    """Importance resampling of all documents towards the benchmark's texts."""
    from gaugeline.llm import importance

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark"), carry=False)


def op12_language(spark, sf_dir):
    """The language of all documents."""
    from gaugeline.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op13_merkle(spark, sf_dir):
    """Leaves, roots and proofs of all documents, some of them tampered with."""
    from gaugeline.llm import merkle

    changed, where = merkle.tampering()
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=changed, where=where)


_ALL = (op1_quality, op2_syncmers, op3_mixing, op4_packing, op5_simhash, op6_lines, op7_secrets, op8_pii, op9_urlfilter, op10_classifier, op11_importance, op12_language, op13_merkle)
QUERIES = {f.__name__: f for f in _ALL}

_URL = "coalesce(url, '')"
_PARKED = f"coalesce(try_cast(regexp_extract(host, '(^|[.])parked-(0|[1-9][0-9]*)[.]example[.]net$', 2) AS BIGINT) < {PARKED}, false)"
_LISTED = " OR ".join([_PARKED, *(f"host = '{h}' OR host LIKE '%.{h}'" for h in BLOCKED_HOSTS)])
#: The CRC32 of each string w of a table hashed: what one byte adds doesn't depend on the others, so it is looked up by its distance from the end.
_CRC = """bits(seed, k, s) AS (SELECT CAST(b AS UBIGINT), 0, CAST(b AS UBIGINT) FROM range(256) r(b) UNION ALL SELECT 256, 0, 4294967295
  UNION ALL SELECT seed, k + 1, xor(s >> 1, (s & 1) * 3988292384) FROM bits WHERE k < 8 * (SELECT max(strlen(w)) FROM hashed)),
 parts AS (SELECT seed, k // 8 AS d, s FROM bits WHERE k % 8 = 0),
 bytes AS (SELECT w, strlen(w) AS n, i, CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT) AS b FROM (SELECT w, unnest(range(strlen(w))) AS i FROM hashed)),
 crc AS (SELECT d.w, xor(xor(bit_xor(p.s), any_value(z.s)), 4294967295) AS c FROM bytes d JOIN parts p ON p.seed = d.b AND p.d = d.n - d.i JOIN parts z ON z.seed = 256 AND z.d = d.n GROUP BY d.w)"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = f"unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w"
_H = "(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS UBIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296"
_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LEAF = lambda n_chars: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", n_chars, "text"))) + ")"

#: Hashes of the engine, trees, rounds and tokenizers can't be said in SQL: the other operators are tested
#: against brute force, by exact round trips and on held-out labels.
ORACLES: dict[str, str] = {
    "op9_urlfilter": f"""WITH u AS (SELECT page_id, translate(regexp_extract({_URL}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract({_URL}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 f AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR {_LISTED} THEN 'block' ELSE 'allow' END AS verdict FROM f""",
    "op11_importance": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_FEATURES} FROM documents), g AS MATERIALIZED (SELECT {_FEATURES} FROM benchmark),
 hashed AS MATERIALIZED (SELECT w FROM d UNION SELECT w FROM g), {_CRC},
 k AS MATERIALIZED (SELECT w, CAST(c % 10000 AS BIGINT) AS b FROM crc),
 s AS (SELECT b, count(*) AS n FROM d JOIN k USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM g JOIN k USING (w) GROUP BY b),
 gains AS MATERIALIZED (SELECT r.b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM d) + 10000 AS DOUBLE) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM g) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b),
 w AS (SELECT doc_id, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM d JOIN k USING (w) JOIN gains ON gains.b = k.b GROUP BY doc_id),
 x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln({_H}))) AS BIGINT) AS score FROM documents LEFT JOIN w USING (doc_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100 THEN place END AS rank FROM r""",
    "op13_merkle": f"""WITH RECURSIVE hashed AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS w FROM documents), {_CRC},
 leaves AS MATERIALIZED (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, CASE WHEN c % 7 = 0 THEN {_LEAF("(n_chars + 1)")} ELSE {_LEAF("n_chars")} END AS told,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents JOIN crc ON w = CAST(doc_id AS VARCHAR)),
 nodes AS (SELECT lang, 0 AS level, pos AS idx, leaf AS h, n FROM leaves
  UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n),
 subroots AS MATERIALIZED (SELECT lang, h, level AS height, row_number() OVER (ORDER BY CAST(encode(lang) AS BLOB) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
 tops AS (SELECT 0 AS level, pos AS idx, h, n FROM subroots
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
 levels AS MATERIALIZED (SELECT l.doc_id, t.level AS step, (l.pos >> t.level) & 1 AS bit, coalesce(s.h, '') AS sib FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM l.lang
   LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.idx = xor(l.pos >> t.level, 1)
  UNION ALL SELECT l.doc_id, r.height + t.level, (r.pos >> t.level) & 1, coalesce(s.h, '') FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) t ON true
   LEFT JOIN tops s ON s.level = t.level AND s.idx = xor(r.pos >> t.level, 1)),
 fold AS (SELECT doc_id, 0 AS step, told AS h FROM leaves
  UNION ALL SELECT f.doc_id, f.step + 1, sha256(CASE WHEN bit = 1 THEN sib || h ELSE h || sib END) FROM fold f JOIN levels USING (doc_id, step)),
 proofs AS (SELECT doc_id, string_agg(sib, '' ORDER BY step) AS sibs FROM levels GROUP BY doc_id)
SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(sibs, '')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT doc_id, arg_max(h, step) AS h FROM fold GROUP BY doc_id) f ON f.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id""",
}
