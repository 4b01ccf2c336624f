"""The queries of the text operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lang_crf, line_dedup, lm_score, merkle, minhash, packing, prefix_trie, syncmers, token_counts, toxicity, url_rules, warc_zip
from tidemark.llm.shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of benchmark items."""
    marks = decontam.contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return marks.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-log-likelihood of every document under a network trained on all of them."""
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines: how many went, and the digest of what stays."""
    found = line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's remainder is not 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    found = lang_crf.identify(docs.select("doc_id", "text"), docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: The rules that the query states, and globs for what they leave open.
URL_RULES = [
    url_rules.host_rule("block", "net/"),
    url_rules.host_rule("allow", "example.net/en/"),
    url_rules.host_rule("block", "example.com/de/"),
    url_rules.host_rule("allow", "org/fr/"),
]
URL_GLOBS = [url_rules.glob_rule("block", g) for g in ("*spam*", "*casino*/*", "*/ads/*", "ads?.*", "*.doubleclick.*")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    judged = url_rules.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES + URL_GLOBS)
    stated = F.col("rule").isin([r.name for r in URL_RULES])
    return judged.select("page_id", "host", "path", F.when(stated, F.col("rule")).alias("rule"), "verdict", F.when(~stated, F.col("rule")).alias("glob"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    pieces = token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), pieces)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


#: Fewer loss-bearing tokens than a sequence has, so that this limit binds.
CONVERSATION_LIMITS = packing.Limits(tokens=2048, segments=16, loss=1024)


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation packed under limits on tokens, segments and loss-bearing tokens, of which only the assistant's are."""
    pieces = packing.pack_conversations(_table(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json"), limits=CONVERSATION_LIMITS)
    return pieces.select("conv_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited form."""
    found = syncmers.fingerprints(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.fingerprint_string("fp").alias("fingerprint"),
        syncmers.fingerprint_string("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC packages and read back."""
    return warc_zip.round_trip(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest tree of documents, and whether each document's proof holds after line breaks of every second one went."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, altered=merkle.leaf_digest("doc_id", "source", "lang", "n_chars", text))
    folded = found.withColumn("folded_root", merkle.fold(F.col("altered"), F.col("proof")))
    proof = F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256")
    return folded.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations of which up to three first turns come from the twentieth conversation before."""
    own = stored(prefix_trie.sequences(_table(spark, sf_dir, "conversations")), "conversations")
    openings = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    opening = F.slice(F.coalesce("opening", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    rebuilt = own.join(openings, F.expr("conv_id - conv_id % 20 = base"), "left").select("conv_id", F.concat(opening, rest).alias("turns"))
    return prefix_trie.prefix_trie(rebuilt)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those whose id's remainder is not 0."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    found = toxicity.score_documents(docs, toxicity.train(docs.where(~held_out), labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "worst")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_near_duplicates, op3_lm_scores, op4_line_dedup, op5_language_id, op6_url_filters, op7_token_counts, op8_packing, op9_fingerprints, op10_warc, op11_merkle_manifest, op12_prefix_trie, op13_toxicity, conversation_packing)}

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(({0})::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _leaf_sql(text: str) -> str:
    one = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    return f"sha256({' || '.join(one.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _levels_sql(name: str, leaves: str) -> str:
    """A tree's nodes (sid, l, i, n, h) over leaves (sid, i, n, h)."""
    return f"""{name} AS (SELECT sid, 0 AS l, i, n, h FROM {leaves}
      UNION ALL SELECT sid, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY sid, l, i // 3, n)"""


def _siblings_sql(nodes: str, rows: str, add: int) -> str:
    return f"""SELECT k, t.l + {add} AS l, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < t.i), '') AS a, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > t.i), '') AS b
      FROM {rows} r JOIN {nodes} t ON t.sid = r.sid AND t.n > 1 AND t.i = r.i // (3 ** t.l)::BIGINT JOIN {nodes} o ON o.sid = t.sid AND o.l = t.l AND o.i // 3 = t.i // 3 GROUP BY k, t.l, t.i"""


ORACLE_SQL = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d0 AS (SELECT *, CASE WHEN {_CRC.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents),
        d AS (SELECT row_number() OVER () AS k, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS sid, {_leaf_sql('text')} AS h, {_leaf_sql('cut')} AS altered FROM d0),
        leaf AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY sid) AS n FROM d),
        {_levels_sql('tree', 'leaf')},
        subroot AS (SELECT sid, h FROM tree WHERE n = 1),
        top0 AS (SELECT 0 AS sid, sid - 1 AS i, count(*) OVER () AS n, h, sid AS own FROM subroot),
        {_levels_sql('top', 'top0')},
        rows1 AS (SELECT k, sid, i FROM leaf), rows2 AS (SELECT k, 0 AS sid, sid - 1 AS i FROM leaf),
        sib AS ({_siblings_sql('tree', 'rows1', 0)} UNION ALL {_siblings_sql('top', 'rows2', 1000)}),
        step AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l) AS s FROM sib),
        proof AS (SELECT k, string_agg(a || b, '' ORDER BY s) AS p FROM step GROUP BY k),
        fold AS (SELECT k, 0::BIGINT AS s, altered AS h FROM leaf UNION ALL SELECT f.k, step.s, sha256(a || f.h || b) FROM fold f JOIN step ON step.k = f.k AND step.s = f.s + 1),
        folded AS (SELECT k, arg_max(h, s) AS folded_root FROM fold GROUP BY k)
        SELECT doc_id, leaf.h AS leaf, subroot.h AS subroot, r.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
        FROM leaf JOIN subroot USING (sid) JOIN folded USING (k) LEFT JOIN proof USING (k), (SELECT h FROM top WHERE n = 1) r""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT conv_id, {_CRC.format('conv_id')} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t)),
        re AS (SELECT h.conv_id, i AS k, m, w FROM h JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT conv_id, 1000000000 + i, m, w FROM h JOIN t USING (conv_id) WHERE i > h),
        seq AS (SELECT conv_id, list(m ORDER BY k) AS ms, list(w ORDER BY k) AS ws FROM re GROUP BY 1),
        every AS (SELECT conv_id, coalesce(ms, []) AS ms, coalesce(ws, []) AS ws FROM h LEFT JOIN seq USING (conv_id)),
        pre AS (SELECT conv_id, d, len(ms) AS n, list_slice(ms, 1, d) AS ms, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM every, unnest(range(0, len(ms) + 1)) AS r(d)),
        node AS (SELECT array_to_string(ms, ',') AS key, d, any_value(ms) AS ms, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM pre GROUP BY 1, 2),
        up AS (SELECT *, CASE WHEN d > 0 THEN array_to_string(list_slice(ms, 1, d - 1), ',') END AS parent FROM node),
        kids AS (SELECT parent AS key, count(*) AS c FROM up WHERE d > 0 GROUP BY 1),
        full_node AS (SELECT up.*, coalesce(c, 0) AS n_children FROM up LEFT JOIN kids USING (key)),
        above AS (SELECT array_to_string(list_slice(ms, 1, e), ',') AS key, n_children, (n_convs - 1) * w AS s FROM full_node, unnest(range(0, d + 1)) AS r(e)),
        sums AS (SELECT key, count(*) FILTER (n_children = 0) AS n_leaves, sum(s)::BIGINT AS saved_tokens FROM above GROUP BY 1)
        SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
        FROM full_node x JOIN sums USING (key) LEFT JOIN node y ON y.key = x.parent AND y.d = x.d - 1""",
    "op1_decontamination": f"""
        WITH item AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
        win AS (
          SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(list_slice(ws, s0, s0 + least(13, len(ws)) - 1), ' ') AS win
          FROM item, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS r(s0) WHERE len(ws) > 0),
        doc AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS ws FROM documents),
        place AS (SELECT k, s0, n, array_to_string(list_slice(ws, s0, s0 + n - 1), ' ') AS win
          FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(ws) - n + 2)) AS r(s0)),
        hit AS (SELECT k, s0, place.n AS n, item FROM place JOIN win ON place.win = win.win AND place.n = win.n),
        covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s0, s0 + n)) AS r(p) GROUP BY k),
        named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM doc LEFT JOIN covered USING (k) LEFT JOIN named USING (k)""",
    "op2_near_duplicates": f"""
        WITH RECURSIVE doc AS (SELECT row_number() OVER () AS k, doc_id, text, {_WORDS} AS ws FROM documents),
        sh AS (SELECT DISTINCT k, array_to_string(list_slice(ws, s0, s0 + least(5, len(ws)) - 1), ' ') AS g
          FROM doc, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS r(s0) WHERE len(ws) > 0),
        n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
        pair AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 5 * c >= 4 * (x.n + y.n - c)
          UNION SELECT x.k, y.k FROM doc x JOIN doc y ON x.text = y.text AND x.k < y.k AND len(x.ws) = 0),
        way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT k, k AS r FROM doc UNION SELECT reach.k, way.b FROM reach JOIN way ON way.a = reach.r),
        root AS (SELECT k, min(r) AS root FROM reach GROUP BY k)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size FROM root JOIN doc USING (k)""",
    "op6_url_filters": r"""
        WITH u AS (
          SELECT page_id,
            coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
          CASE WHEN host || path LIKE '%spam%' THEN '*spam*' WHEN host || path LIKE '%casino%/%' THEN '*casino*/*'
            WHEN host || path LIKE '%/ads/%' THEN '*/ads/*' WHEN host || path LIKE 'ads_.%' THEN 'ads?.*'
            WHEN host || path LIKE '%.doubleclick.%' THEN '*.doubleclick.*' END AS fits FROM u)
        SELECT page_id, host, path, rule,
          CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN fits IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
          CASE WHEN rule IS NULL THEN fits END AS glob FROM r""",
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
}
