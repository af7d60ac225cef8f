"""The queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.llm import oracles, quality
from rinse.llm.alignment import align_documents
from rinse.llm.decontaminate import contamination
from rinse.llm.html_extraction import extract
from rinse.llm.merkle import changed_paragraphs, edited_fingerprints
from rinse.llm.minhash import near_duplicates
from rinse.llm.packing import pack_documents
from rinse.llm.preferences import answer_turns, paired, preference_turns
from rinse.llm.prefix_trie import conversation_trie
from rinse.llm.suffix_dedup import remove_repeats
from rinse.llm.token_files import read_tokens, write_tokens
from rinse.llm.url_filter import judge, write_rules
from rinse.llm.warc import read_records, write_pages
from rinse.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op1_url_filter": oracles.URL_FILTER,
    "op5_warc": oracles.WARC,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op7_near_duplicates": oracles.NEAR_DUPLICATES,
    "op9_preferences": oracles.PREFERENCE_PAIRS,
    "op9_preference_turns": oracles.PREFERENCES,
    "op10_merkle": oracles.MERKLE,
    "op10_located_edits": oracles.MERKLE_EDITS,
    "op11_main_text": oracles.MAIN_TEXT,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
}


def query(build: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
    """Register a function of the session and of a reader of tables under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(spark, lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

    QUERIES[build.__name__] = run
    return build


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query
def op1_url_filter(spark, table):
    folder = scratch(spark, "rules")
    write_rules(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), folder)
    judged = judge(table("pages").select("page_id", "url"), folder)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op2_token_files(spark, table):
    folder = scratch(spark, "tokens")
    write_tokens(table("documents"), folder)
    return read_tokens(spark, folder, with_ids=False)


@query
def op3_best_fit_packing(spark, table):
    return pack_documents(table("documents"))


@query
def op4_suffix_dedup(spark, table):
    return remove_repeats(table("documents"), with_text=True).withColumn("has_repeats", F.col("n_removed") > 0)


@query
def op5_warc(spark, table):
    folder = scratch(spark, "archives")
    write_pages(table("pages"), folder)
    records = read_records(spark, folder, payload=False, verify=True)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_decontamination(spark, table):
    found = contamination(table("documents"), table("benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op7_near_duplicates(spark, table):
    found = near_duplicates(table("documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op8_quality(spark, table):
    docs = table("documents")
    model = quality.train(docs, table("labels"), metadata=["n_chars"])
    scored = quality.score(docs, model, metadata=["n_chars"])
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


@query
def op9_preferences(spark, table):
    """Each conversation is chosen over itself with the last answer of another; the prompt is what they share."""
    pairs = paired(answer_turns(table("conversations")))
    for name in ("chosen_spans", "rejected_spans"):
        pairs = pairs.withColumn(name, F.transform(name, lambda span: F.array(span["start"], span["end"])))
    return pairs


@query
def op9_preference_turns(spark, table):
    """Each conversation with an even id is chosen over the next one; a row for each turn."""
    turns = table("conversations")
    pair = F.floor(F.col("conv_id") / 2)
    pairs = turns.select((2 * pair).alias("pair_id")).distinct()
    pairs = pairs.select("pair_id", F.col("pair_id").alias("chosen"), (F.col("pair_id") + 1).alias("rejected"))
    return preference_turns(turns, pairs)


@query
def op10_merkle(spark, table):
    return edited_fingerprints(table("documents"))


@query
def op10_located_edits(spark, table):
    """Where texts have changed, found by descending the trees: here each ``en`` at a word's end was edited."""
    before = table("documents").select("doc_id", "text")
    return changed_paragraphs(before, before.withColumn("text", F.replace("text", F.lit("en "), F.lit("EN "))))


@query
def op11_main_text(spark, table):
    return extract(table("pages"))


@query
def op12_prefix_trie(spark, table):
    return conversation_trie(table("conversations"))


@query
def op13_alignment(spark, table):
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_documents(table("documents"), *paths)
