"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.bpe_automaton import round_trip
from pixelmill.llm.exact_dedup import content_sort
from pixelmill.llm.harmonic_packing import pack
from pixelmill.llm.line_dedup import drop_repeated_lines, repeated_runs
from pixelmill.llm.merkle import folded, manifest, proof_text
from pixelmill.llm.mixing import mixture
from pixelmill.llm.near_dedup import near_duplicates
from pixelmill.llm.prefix_trie import prefix_trie, reopened
from pixelmill.llm.quality_cnn import score, train
from pixelmill.llm.quality_rules import BASE, POLICIES, RULES, ablations, apply_policy, ledger
from pixelmill.llm.sharding import shard_by_bytes
from pixelmill.llm.token_lengths import length_histogram, token_lengths
from pixelmill.llm.wrapper_induction import extract
from pixelmill.session import work_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(table(spark, sf_dir, "documents"), carry=["doc_id", "source", "lang"])
    shares = [f"{x}_{d}" for d in ("source", "lang", "topic") for x in ("wanted", "attained")]
    return mixed.select("row.doc_id", "mix_source", "mix_lang", "mix_topic", F.col("mix_tokens").alias("n_tokens"), "mix_weight", "probability", "sampled", *shares)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = work_table(ledger(table(spark, sf_dir, "documents")), "rule-ledger")
    judged = apply_policy(entries, "v1")
    return judged.withColumn("base_failed", F.col("fail_mask").bitwiseAND(BASE) != 0)


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule what it drops, alone and with others, from one stored ledger (op3)."""
    entries = work_table(ledger(table(spark, sf_dir, "documents")), "rule-ledger")
    first, *rest = [ablations(entries, policy).withColumn("policy", F.lit(policy)) for policy in POLICIES]
    return reduce(DataFrame.unionByName, rest, first)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="max")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return length_histogram(work_table(lengths, "token-lengths"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped_lines", F.sha2(F.col("text"), 256).alias("text_sha256"))


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal runs of lines that stood before, as ``op10_line_dedup`` deletes them."""
    return repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "start", "lines", "words")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, of which half are presented without their line breaks."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without_breaks = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proven = manifest(table(spark, sf_dir, "documents"), shown={"text": without_breaks}).withColumn("folded_root", folded(F.col("shown_leaf"), F.col("path")))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie(*reopened(table(spark, sf_dir, "conversations")))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sharding_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any sharding by bytes has (op1): all rows and bytes, slots without gaps, equal texts in one shard, and no two
    shards further apart than the largest group of equal texts."""
    placed = work_table(op1_sharding(spark, sf_dir), "shards")
    shards = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_distinct("slot").alias("n_slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    groups = placed.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n_shards"), F.sum("size").alias("bytes"))
    whole = groups.agg(F.max("n_shards").alias("shards_of_a_text"), F.max("bytes").alias("largest"))
    gapless = (F.col("n_slots") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    found = shards.agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n").alias("n_rows"), F.sum("bytes").alias("bytes"), F.every(gapless).alias("gapless"), (F.max("bytes") - F.min("bytes")).alias("spread"))
    both = found.withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one")  # one row each
    return both.select("n_shards", "n_rows", "bytes", "gapless", "shards_of_a_text", (F.col("spread") <= F.col("largest")).alias("even"))


def packing_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any packing has (op12): all documents, each token of one in one piece, sequences without gaps, padded tokens."""
    pieces = work_table(op12_packing(spark, sf_dir), "packed")
    documents = pieces.groupBy("doc_id").agg(F.sum("length").alias("held"), F.max("doc_tokens").alias("doc_tokens"), F.max(F.col("start") + F.col("length")).alias("end"), F.count_distinct("start").alias("starts"), F.count(F.lit(1)).alias("n"))
    whole = (F.col("held") == F.col("doc_tokens")) & (F.col("end") == F.col("doc_tokens")) & (F.col("starts") == F.col("n"))
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("offsets"), F.count(F.lit(1)).alias("n"))
    gapless = (F.col("fill") == F.col("end")) & (F.col("offsets") == F.col("n")) & (F.col("fill") <= 2048)
    padded = F.when(F.bit_count("fill") == 1, 0).otherwise(2048 - F.col("fill"))
    per_document = documents.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~whole).alias("n_torn")).withColumn("one", F.lit(1))
    per_sequence = filled.agg(F.count_if(~gapless).alias("n_gaps"), F.sum(padded).cast("long").alias("padding")).withColumn("one", F.lit(1))
    return per_document.join(per_sequence, "one").drop("one")


#: Words, lines and three-word windows by regular expressions and lists; the mask is the sum of the bits.
LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
  FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id
),
ledger AS (SELECT *, CAST(MASK AS INT) AS fail_mask FROM m)
""".replace("MASK", " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES))
SQL_OP3 = f"{LEDGER_SQL} SELECT *, 'v1' AS policy, fail_mask & {POLICIES['v1']} = 0 AS kept, fail_mask & {BASE} <> 0 AS base_failed FROM ledger"
SQL_ABLATIONS = LEDGER_SQL + " UNION ALL ".join(
    f"SELECT '{policy}' AS policy, '{r.name}' AS rule, count(*) FILTER (WHERE fail_mask & {1 << r.bit} <> 0) AS n_failed, "
    f"count(*) FILTER (WHERE fail_mask & {heeded} = {1 << r.bit}) AS n_failed_alone, count(*) FILTER (WHERE fail_mask & {heeded & ~(1 << r.bit)} = 0) AS n_kept_without FROM ledger"
    for policy, heeded in POLICIES.items()
    for r in RULES
    if heeded >> r.bit & 1
)

SQL_OP6 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


#: A run is three lines, or one line of 300 bytes or more; all but its first occurrence go.
#: Later stretches of three lines, of fifty words, or of one line of 300 bytes, and the lines that stand in them.
SQL_LATER_LINES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, text, lines, unnest(range(0, len(lines))) AS start FROM d),
stretches AS (
  SELECT doc_id, text, start, size, lines[start + 1 : start + size] AS part
  FROM (SELECT *, unnest([1, 2, 3]) AS size FROM starts) WHERE start + size <= len(lines)
),
runs AS (
  SELECT doc_id, text, start, size, array_to_string(part, chr(10)) AS gram FROM stretches
  WHERE size = 3 OR (size = 1 AND strlen(part[1]) >= 300) OR len(regexp_extract_all(array_to_string(part, ' '), '[^\x20\x09-\x0D]+')) >= 50
),
later AS (
  SELECT doc_id, text, start, size FROM runs
  QUALIFY row_number() OVER (PARTITION BY size, gram ORDER BY doc_id, start) > 1
),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(start, start + size)) AS pos FROM later),
"""
SQL_OP10 = SQL_LATER_LINES + """
kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.pos) AS n_dropped_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS cleaned
  FROM (SELECT doc_id, text, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d) l
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.text = l.text AND g.pos = l.pos
  GROUP BY l.doc_id, l.text
)
SELECT doc_id, n_lines, n_dropped_lines, sha256(cleaned) AS text_sha256 FROM kept
"""
SQL_LINE_RUNS = SQL_LATER_LINES + r"""
islands AS (
  SELECT g.doc_id, g.pos, g.pos - row_number() OVER (PARTITION BY g.doc_id, g.text ORDER BY g.pos) AS island, g.text,
         len(regexp_extract_all(d.lines[g.pos + 1], '[^\x20\x09-\x0D]+')) AS words
  FROM gone g JOIN d ON d.doc_id = g.doc_id AND d.text = g.text
)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS lines, CAST(sum(words) AS BIGINT) AS words
FROM islands GROUP BY doc_id, text, island
"""

#: All pairs that share a shingle, counted; components by the closure of the links.
SQL_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc, met) AS (SELECT DISTINCT a, a FROM sides UNION SELECT reach.doc, sides.b FROM reach JOIN sides ON sides.a = reach.met),
smallest AS (SELECT doc, min(met) AS component FROM reach GROUP BY doc)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN smallest ON smallest.doc = w.doc_id
"""
SQL_SHARDING = """SELECT 40::BIGINT AS n_shards, count(*) AS n_rows, CAST(sum(coalesce(strlen(text), 0) + 16) AS BIGINT) AS bytes, true AS gapless, 1::BIGINT AS shards_of_a_text, true AS even FROM documents"""
SQL_PACKING = "SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_torn, 0::BIGINT AS n_gaps, 0::BIGINT AS padding FROM documents"

#: CRC-32 of the decimal digits of a column, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(COLUMN::VARCHAR, '')]),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, _: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)))"""


def crc32_sql(column: str) -> str:
    return CRC32_SQL.replace("COLUMN", column)


LEAF_SQL = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
#: Levels by recursion, siblings by comparing the nodes of a run, paths level by level, folding by recursion.
SQL_OP11 = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {crc32_sql("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents
),
leaves AS (
  SELECT doc_id, source, leaf, shown_leaf, row_number() OVER (ORDER BY doc_id) AS doc,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256({LEAF_SQL}) AS leaf, sha256({LEAF_SQL.replace("text", "shown")}) AS shown_leaf FROM d)
),
up AS (
  SELECT source, 0 AS level, place, leaf AS node, n FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY source, level, place // 3
),
subroots AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, place, node, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, place // 3
),
nodes AS (SELECT coalesce('s' || source, '') AS tree, level, place, node FROM up WHERE n > 1 UNION ALL SELECT 'top', 1000 + level, place, node FROM top WHERE n > 1),
around AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before,
         coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3
  GROUP BY a.tree, a.level, a.place
),
path AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY level) AS step, before, after
  FROM (
    SELECT doc, level, before, after FROM leaves JOIN around ON tree = coalesce('s' || source, '') AND level < 1000 AND around.place = leaves.place // CAST(pow(3, level) AS BIGINT)
    UNION ALL
    SELECT doc, level, before, after FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source
    JOIN around ON tree = 'top' AND around.place = s.place // CAST(pow(3, level - 1000) AS BIGINT)
  )
),
fold AS (
  SELECT doc, 0 AS step, shown_leaf AS node FROM leaves
  UNION ALL
  SELECT fold.doc, path.step, sha256(before || node || after) FROM fold JOIN path ON path.doc = fold.doc AND path.step = fold.step + 1
),
folded AS (SELECT doc, arg_max(node, step) AS folded_root FROM fold GROUP BY doc),
proofs AS (SELECT doc, string_agg(before || after, '' ORDER BY step) AS proof FROM path GROUP BY doc)
SELECT doc_id, leaf, s.node AS subroot, top.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = top.node AS verified
FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source JOIN top ON top.n = 1
JOIN folded ON folded.doc = leaves.doc LEFT JOIN proofs ON proofs.doc = leaves.doc
"""

#: A prefix is the chain of its turns' digests; the ancestors of a node are the shorter prefixes of its smallest member.
SQL_OP13 = f"""
WITH t AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS rank
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)
),
c AS (SELECT conv_id, count(*) AS n, {crc32_sql("conv_id")} % 9 AS h, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, rank AS place, digest, bytes FROM c JOIN t ON t.conv_id = c.base WHERE rank < h
  UNION ALL
  SELECT c.conv_id, rank - c.h + least(c.h, coalesce(b.n, 0)), digest, bytes FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE rank >= c.h
),
p AS (
  SELECT conv_id, place + 1 AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place) AS node, bytes FROM r
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM c
),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members FROM (SELECT * FROM p QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY node
),
met AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY node, depth),
below AS (SELECT left(node, len(node) - 64) AS node, count(*) AS n_children FROM met WHERE depth > 0 GROUP BY ALL),
nodes AS (SELECT met.*, coalesce(n_children, 0) AS n_children FROM met LEFT JOIN below ON below.node = met.node),
sums AS (
  SELECT p.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * nodes.bytes) AS BIGINT) AS saved_tokens
  FROM nodes JOIN p ON p.conv_id = nodes.conv_id AND p.depth <= nodes.depth GROUP BY p.node
)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, nodes.n_children, n_leaves, saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
FROM nodes JOIN sums ON sums.node = nodes.node LEFT JOIN ends ON ends.node = nodes.node
LEFT JOIN nodes up ON nodes.depth > 0 AND up.node = left(nodes.node, len(nodes.node) - 64)
"""


QUERIES = (
    op1_sharding,
    op2_mixing,
    op3_quality_rules,
    op4_quality_classifier,
    op5_near_dedup,
    op6_exact_dedup,
    op7_html_extraction,
    op8_token_counts,
    op9_bpe,
    op10_line_dedup,
    line_runs,
    op11_merkle_manifest,
    op12_packing,
    op13_prefix_trie,
    rule_ablations,
    sharding_properties,
    packing_properties,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_dedup": SQL_OP5,
        "sharding_properties": SQL_SHARDING,
        "packing_properties": SQL_PACKING,
        "op3_quality_rules": SQL_OP3,
        "rule_ablations": SQL_ABLATIONS,
        "op6_exact_dedup": SQL_OP6,
        "op10_line_dedup": SQL_OP10,
        "line_runs": SQL_LINE_RUNS,
        "op11_merkle_manifest": SQL_OP11,
        "op13_prefix_trie": SQL_OP13,
    }
