"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import fit_quality, score_quality
from .decontaminate import find_leaks
from .hostrules import host_rules
from .licenses import CUE, TEMPLATES, scan_licenses
from .mixing import mix_by_weight
from .neardup import near_duplicates
from .ngrams import fold, score, train
from .substrings import remove_repeated_windows
from .tokencounts import load_pieces, token_counts
from .warczip import through_archives

#: A public vocabulary; the file stays where it is.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_ids (benchmark items that the text holds), share (most of an item that is
    covered), refilled (slots filled anew), leaked."""
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), F.array_sort("leaks.item_id").alias("item_ids"), F.array_max("leaks.share").alias("share"), F.array_max("leaks.refilled").alias("refilled"), (F.size("leaks") > 0).alias("leaked"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path (source/lang/doc_id.txt), own_license, own_score, license_dir, license."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = scan_licenses(docs.select("doc_id", "text", path.alias("path")), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "path", "own_license", "own_score", "license_dir", "license")


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, class_id (the smallest doc_id of the near-duplicate class)."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "class_id")


def op4_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix_by_weight(docs, carry=["doc_id", "source"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five rule figures, base_failed, host_failed (the verdict of its host), kept."""
    out = host_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "rule.*", "base_failed", "host_failed", "kept")


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    out = through_archives(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), load_pieces(PIECES), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_tokens")


def op8_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out = remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit_quality(docs.filter(fold() != 0), table(spark, sf_dir, "labels"))
    out = score_quality(docs, network, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(fold() != 1))
    out = score(docs, model, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "n_known", "base_score", "score")
    return out.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_license_scan": op2_license_scan,
    "op4_flow_mix": op4_flow_mix,
    "op5_host_rules": op5_host_rules,
    "op3_bagminhash": op3_bagminhash,
    "op6_warc_zip": op6_warc_zip,
    "op7_trie_tokens": op7_trie_tokens,
    "op8_substring_doubling": op8_substring_doubling,
    "op9_byte_cnn": op9_byte_cnn,
    "op10_kneser_ney": op10_kneser_ney,
}

_TEMPLATES = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TEMPLATES))

ORACLE_SQL = {
    "op2_license_scan": rf"""
WITH t(template, license, text) AS (VALUES {_TEMPLATES}),
ttf AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1 + {len(TEMPLATES)}) / (1 + count(*))::DOUBLE) + 1 AS idf FROM ttf GROUP BY term),
tw AS (SELECT template, license, term, tf * idf AS w FROM ttf JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS n FROM tw GROUP BY template),
d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, coalesce(text, '') AS body FROM documents),
u AS (SELECT DISTINCT doc_id, path, length(body) AS chars, unit FROM (SELECT doc_id, path, body, unnest(string_split(regexp_replace(body, '([.;!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS unit FROM d)
      WHERE regexp_matches(unit, '{CUE}')),
tf AS (SELECT doc_id, path, chars, unit, term, count(*) AS tf FROM (SELECT *, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS term FROM u) GROUP BY ALL),
x AS (SELECT tf.*, tf.tf * coalesce(idf, ln({len(TEMPLATES) + 1}::DOUBLE) + 1) AS x FROM tf LEFT JOIN idf USING (term)),
xn AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS n FROM x GROUP BY ALL),
dot AS (SELECT x.doc_id, x.path, x.chars, x.unit, tw.license, tw.template, sum(x.x * tw.w) AS dot FROM x JOIN tw USING (term) GROUP BY ALL),
sc AS (SELECT dot.doc_id, dot.path, dot.chars, dot.unit, license, round(max(dot / xn.n / tn.n), 6) AS score FROM dot JOIN xn USING (doc_id, unit) JOIN tn USING (template) GROUP BY ALL HAVING score >= 0.6),
own AS (SELECT doc_id, path, chars, arg_min(license, (-score, license)) AS own_license, max(score) AS own_score FROM sc GROUP BY ALL),
cov AS (SELECT doc_id, sum(length(unit)) AS covered FROM (SELECT DISTINCT doc_id, unit FROM sc) GROUP BY doc_id),
files AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score FROM own JOIN cov USING (doc_id)
          WHERE regexp_matches(path, '(?i)(^|/)(un)?licen[sc]e(s)?([.-][^/]*)?$|(?i)(^|/)copying([.-][^/]*)?$') OR covered >= chars * 0.5),
g AS (SELECT dir AS license_dir, arg_min(own_license, (-own_score, own_license)) AS granted FROM files GROUP BY dir),
p AS (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM d),
near AS (SELECT path, max(struct_pack(n := length(license_dir), license_dir := license_dir, granted := granted)) AS n
         FROM p JOIN g ON license_dir = '' OR dir = license_dir OR starts_with(dir, license_dir || '/') GROUP BY path)
SELECT d.doc_id, d.path, own_license, own_score, CASE WHEN own_license IS NULL THEN near.n.license_dir END AS license_dir, coalesce(own_license, near.n.granted) AS license
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.path = d.path
""",
    "op4_flow_mix": r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, 1.5 * (sum(n) OVER ())::DOUBLE - coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
             (sum(w) OVER (ORDER BY 2.0 * n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open FROM w),
c AS (SELECT *, rest * w / open > 2 * n AS over FROM o),
k AS (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) FILTER (over) OVER (), 0))::DOUBLE AS share, (sum(w) FILTER (NOT over) OVER ())::DOUBLE AS ws FROM c),
t AS (SELECT source, n, CASE WHEN over THEN 2.0::DOUBLE * n ELSE share * w / ws END AS target FROM k),
line AS (SELECT d.*, t.n, t.target, round(target)::BIGINT AS q,
                sum(size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, digest)), size, digest ROWS UNBOUNDED PRECEDING) - size AS c
         FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
       (greatest(0, least(q, c + size) - c) + greatest(0, least(q, c + size + n) - (c + n)))::BIGINT AS taken
FROM line
""",
    "op5_host_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN r USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM b GROUP BY source),
m AS (SELECT (sum(f) + 0.5) / (sum(n) + 1) AS m, var_pop(f / n) AS v, avg(1 / n) AS w FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * w, 1e-6) - 1, 1.0), 1e6) AS k FROM m),
q AS (SELECT source, (h.f + p.m * p.k) / (h.n + p.k) AS r, h.n + p.k + 1 AS size, p.m FROM h, p),
v AS (SELECT source, r - 2.0 * sqrt(r * (1 - r) / size) > least(1.5 * m, 0.5) AS host_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
""",
    "op8_substring_doubling": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (g)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
