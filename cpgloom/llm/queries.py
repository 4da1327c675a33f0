"""Registered queries of the operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.llm import (
    centroids,
    chat,
    decontaminate,
    exact_dedup,
    hash_forest,
    line_dedup,
    lm_score,
    merkle,
    ngram_join,
    quality,
    sentencepiece_fst,
    suffix_dedup,
    warc,
)
from cpgloom.llm.common import sha256_list
from cpgloom.operators.sizing import sized
from cpgloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_discriminant")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query(
    "op10_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, line,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM lines),
    runs AS (  -- the shortest run of ten words or more from each line
      SELECT a.doc_id, a.place, min(b.place) AS last FROM summed a JOIN summed b
      ON a.doc_id = b.doc_id AND b.place >= a.place AND b.upto - a.upto + a.words >= 10 GROUP BY ALL),
    named AS (
      SELECT r.doc_id, r.place, r.last, list(l.line ORDER BY l.place) AS run FROM runs r JOIN lines l
      ON l.doc_id = r.doc_id AND l.place BETWEEN r.place AND r.last GROUP BY ALL),
    later AS (
      SELECT doc_id, place, last FROM named
      QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, place) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(place, last + 1)) AS place FROM later)
    SELECT d.doc_id, count(l.place) AS n_lines, count(g.place) AS n_removed,
           coalesce(sum(CASE WHEN g.place IS NULL THEN strlen(l.line) END), 0)::BIGINT AS kept_line_bytes
    FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place
    GROUP BY d.doc_id""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    size = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return out.select("doc_id", "n_lines", "n_removed", size.alias("kept_line_bytes"))


@query(
    "op3_decontamination",
    r"""
    WITH item AS (
      SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    windows AS (
      SELECT DISTINCT item_id, w[i : i + 9] AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
    doc AS (
      SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
    starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes),
    hit AS (SELECT s.doc_id, s.i, s.n, x.item_id FROM (SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM starts) s JOIN windows x ON s.win = x.win),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
    items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_list(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op2_ngram_jaccard_join",
    r"""
    WITH RECURSIVE doc AS (
      SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, w[i : i + 3] AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM both_have JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
    edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
    FROM doc d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) USING (doc_id)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_fst.decode(sentencepiece_fst.encode(docs))
    return both.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        sentencepiece_fst.ids_sha256().alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_lm_cross_entropy_difference")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that the labels call good and not toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("good", F.lit(True))
    return lm_score.score(docs.join(sized(good), "doc_id", "left"), F.col("good"))


@query("op7_hash_prefix_forest")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


_BASE32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)


@query(
    "op8_warc",
    f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to
    FROM q""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, folder)
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to_id")).alias("refers_to"),
    )


_MARKED = r"(<\\*\|turn\|>|<\\*\|text\|>|<\\*\|end\|>|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>)"


@query(
    "op5_chat_format",
    rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    x AS (SELECT *, len(regexp_extract_all(role, '{_MARKED}')) + len(regexp_extract_all(text, '{_MARKED}')) AS slashes FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           sum(length(role) + length(text) + slashes + {len(chat.TURN + chat.TEXT + chat.END)})::BIGINT AS formatted_chars
    FROM x GROUP BY conv_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.render(turns))


def _lloyd_sql(rounds: int = 10) -> str:
    """Each round as two common tables: the centroids ``c<i>`` and the assignment ``a<i>``."""
    parts = [
        """v AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "e AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v)",
        """c0 AS MATERIALIZED (
      SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (
        SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM v WHERE vec_id IS NOT NULL) WHERE k < 8)""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
      SELECT vec_id, k, d FROM (SELECT vec_id, k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{i} c USING (i) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        )
        if i < rounds:  # floor of the mean, also of negative sums
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
      SELECT c.k, coalesce(s.x, c.x) AS x, c.i FROM c{i} c LEFT JOIN (
        SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM e JOIN a{i} USING (vec_id) GROUP BY ALL) s USING (k, i))"""
            )
    return f"""
    WITH {", ".join(parts)},
    named AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
    SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM a{rounds} JOIN named USING (k)"""


@query("op11_centroid_clustering", _lloyd_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.summarised(found, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _merkle_sql(levels: int = 6) -> str:
    """The tree level by level: ``t<i>`` within sources, ``u<i>`` above them; 16 ** levels rows a source at most."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join([field("doc_id"), field("source"), field("lang"), field("n_chars"), field(text)]) + ")"

    def tree(name: str, group: str, first: str) -> list[str]:
        """Nodes of each level with their flanks; a level ends where one node is left."""
        out = [f"{name}0 AS ({first})"]
        for i in range(levels):
            out.append(
                f"""{name}r{i} AS (
      SELECT g, pos // 16 AS run, list(h ORDER BY pos) AS hs, max(n) AS n FROM {name}{i} GROUP BY ALL)"""
            )
            out.append(
                f"""{name}{i + 1} AS (
      SELECT g, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(list_aggregate(hs, 'string_agg', '')) END AS h, (n + 15) // 16 AS n FROM {name}r{i})"""
            )
        return out

    def climb(out: str, source: str, name: str, i: int) -> str:
        """Rows one level higher: proof and folded digest grow by the flanks of the row's node."""
        return f"""{out} AS (
      SELECT x.* EXCLUDE (p, proof, f, before, after, single), p // 16 AS p, proof || before || after AS proof,
             CASE WHEN single THEN f ELSE sha256(before || f || after) END AS f
      FROM (SELECT s.*, r.n = 1 AS single,  -- of one node, no parent
               coalesce(list_aggregate(r.hs[1 : (s.p % 16)::INTEGER], 'string_agg', ''), '') AS before,
              coalesce(list_aggregate(r.hs[(s.p % 16)::INTEGER + 2 :], 'string_agg', ''), '') AS after
            FROM {source} s JOIN {name}r{i} r ON s.g IS NOT DISTINCT FROM r.g AND s.p // 16 = r.run) x)"""

    lower = hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    parts = [
        f"""leaf AS (
      SELECT doc_id, source, {hashed("text")} AS leaf, CASE WHEN cut THEN {lower} ELSE {hashed("text")} END AS f,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {hashed("text")}) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
      FROM (SELECT d.*, coalesce(crc % 5 = 0, false) AS cut FROM documents d LEFT JOIN crc USING (doc_id)))""",
        *tree("t", "source", "SELECT source AS g, pos, leaf AS h, n FROM leaf"),
        f"tops AS (SELECT g AS source, h FROM t{levels})",
        *tree("u", "", "SELECT 0 AS g, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM tops"),
        "s0 AS (SELECT doc_id, source, leaf, source AS g, pos AS p, '' AS proof, f FROM leaf)",
        *[climb(f"s{i + 1}", f"s{i}", "t", i) for i in range(levels)],
        f"""w0 AS (
      SELECT s.* EXCLUDE (g, p), 0 AS g, o.p, o.subroot FROM s{levels} s JOIN (
        SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM tops) o ON s.source IS NOT DISTINCT FROM o.source)""",
        *[climb(f"w{i + 1}", f"w{i}", "u", i) for i in range(levels)],
    ]
    return f"""
    WITH RECURSIVE bytes AS (  -- CRC-32 of the decimal id, bit by bit
      SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
    crc_steps AS (
      SELECT doc_id, s, 0 AS i, 4294967295::BIGINT AS c FROM bytes
      UNION ALL
      SELECT doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(s[i // 9 + 1])::BIGINT)
                                    WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END
      FROM crc_steps WHERE i < 9 * length(s)),
    crc AS (SELECT doc_id, xor(c, 4294967295::BIGINT) AS crc FROM crc_steps WHERE i = 9 * length(s)),
    {", ".join(parts)}
    SELECT doc_id, leaf, subroot, (SELECT h FROM u{levels}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM u{levels}) AS verified
    FROM w{levels}"""


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.lowered())
    verified = F.col("folded_root") == F.col("root")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified.alias("verified"))


@query(
    "op13_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_copies(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
