"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlake.llm import bpe, decontam, exact_dedup, html_extract, importance, langid, line_dedup, ngram_join, prefix_trie, secrets, sharding, suffix_dedup, token_records
from partlake.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        "doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    return sharding.interleave_shards(slim, n_shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train_on(docs))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip_column(_table(spark, sf_dir, "documents"), ranks, pattern).select(
        "doc_id",
        F.expr("length(ids) DIV 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_pages(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-records")
    path = scratch.new_path("records")
    docs, file = _table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    token_records.write_token_records(docs, path, file, end_id=2, split_added=False)
    read = token_records.read_token_records(spark, path).select(
        "part", "row", "doc_id", F.expr("length(ids) DIV 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    read = scratch.write(read, "read", keep=True)
    scratch._delete(path)
    # ids before a record: those of earlier files, one row a file, and those earlier in its own file
    files = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    in_file = Window.partitionBy("part").orderBy("row")
    return (
        read.withColumn("upto", F.sum("n_tokens").over(in_file))
        .join(files, "part")
        .select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    said = langid.predict_languages(docs, profiles)
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance.resample(docs, target, percent=10, min_words=20, longest=1, buckets=10_000, seed=2024)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"), every=100, heads=6)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_html_extraction": op7_html_extraction,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_records": op9_token_records,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_trie": op13_conversation_trie,
}

#: CRC-32 of the bytes of a text column ``{0}``, a bit at a time.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"""

ORACLE = {
    "op4_decontamination": r"""
        WITH w AS (
          SELECT false AS is_item, doc_id AS id,
                 list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
          UNION ALL
          SELECT true, item_id,
                 list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
        s AS (
          SELECT is_item, id, unnest(list_distinct(CASE
                   WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS part
          FROM w),
        n AS (SELECT id, count(*) AS n_item FROM s WHERE is_item GROUP BY id),
        m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
              FROM s d JOIN s i USING (part) WHERE NOT d.is_item AND i.is_item GROUP BY ALL)
        SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
        FROM m JOIN n ON n.id = m.item_id WHERE n_shared * 5 >= n_item * 4
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        l AS (
          SELECT doc_id, list_sort(list_distinct(CASE
                   WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS parts
          FROM w),
        n AS (SELECT doc_id, len(parts) AS n FROM l),
        s AS (SELECT doc_id, unnest(parts) AS part FROM l),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
              FROM s a JOIN s b ON a.part = b.part AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * o >= 85 * (x.n + y.n - o)),
        r(doc_id, other) AS (
          SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT r.doc_id, any_value(n.n) AS n_shingles, min(r.other) AS component_id
        FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS len,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        r AS (
          SELECT doc_id, text_sha256,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """,
    "op11_line_dedup": r"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
        k AS (
          SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM l),
        f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
              GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op12_importance_resampling": r"""
        WITH x AS (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
        w AS (
          SELECT side, doc_id, unnest(regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM x),
        b AS (SELECT word, {crc} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w)),
        f AS (SELECT side, doc_id, bucket FROM w JOIN b USING (word)),
        n AS (SELECT r.bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
              FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN f ON f.bucket = r.bucket GROUP BY r.bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE
                / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
        d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
              FROM f JOIN g USING (bucket) WHERE side = 's' GROUP BY doc_id),
        z AS (
          SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln(
                   (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM documents LEFT JOIN d USING (doc_id)),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
              FROM z WHERE n_features >= 20)
        SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
        FROM z LEFT JOIN r USING (doc_id)
    """.replace("{crc}", _CRC32.format("word")),
    "op13_conversation_trie": r"""
        WITH o AS (
          SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                   ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, turns, {crc} % 6 AS h FROM (SELECT *, c::VARCHAR AS word FROM o)),
        b AS (SELECT h.c, list_concat(coalesce(o.turns[1:h.h], []), h.turns[h.h + 1:]) AS path
              FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
        p AS (SELECT c, path, len(path) AS length, unnest(range(len(path) + 1)) AS d FROM b),
        n AS (
          SELECT d, path[1:d] AS node, min(c) AS c, count(*) AS n_convs,
                 string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = d) AS ends
          FROM p GROUP BY ALL),
        v AS (SELECT a.*, b.c AS above, (a.n_convs - 1) * coalesce(length(a.node[a.d].t), 0) AS saved,
                     (SELECT count(*) FROM n x WHERE x.d = a.d + 1 AND x.node[1:a.d] = a.node) AS n_children
              FROM n a LEFT JOIN n b ON b.d = a.d - 1 AND b.node = a.node[1:a.d - 1])
        SELECT a.c AS conv_id, a.d AS depth, any_value(a.above) AS parent_conv_id, any_value(a.n_convs) AS n_convs,
               any_value(a.n_children) AS n_children, count(*) FILTER (u.n_children = 0) AS n_leaves,
               sum(u.saved) AS saved_tokens, sha256(coalesce(any_value(a.ends), '')) AS ends_sha256
        FROM v a JOIN v u ON u.d >= a.d AND u.node[1:a.d] = a.node GROUP BY a.c, a.d
    """.replace("{crc}", _CRC32.format("word")),
}
