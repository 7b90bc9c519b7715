"""The registered queries: each operator over the given tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import lexicons
from sievework.config import (
    CurationConfig,
    EmbeddingSettings,
    LengthBounds,
    NearDupSettings,
)
from sievework.functions import prompts, rules, shingles, text
from sievework.operators import near_dup, novelty, reports, reward, scoring, select, split, tagging
from sievework.operators.exact_dedup import exact_dedup_keep_best
from sievework.plans import clean as cleaning
from sievework.sources import readers, writers
from sievework.sources.schemas import TRAINING_RECORD
from sievework.storage import materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

# The documents are longer than the texts the default bounds are made for.
BOUNDS = LengthBounds(min_words=4, max_words=2000, max_chars=20_000)
NEAR_DUP = NearDupSettings(threshold=0.7)
BLOCKLIST = (
    "idiot", "moron", "scum", "clown", "trash", "loser", "worthless", "pathetic",
    "stupid", "disgusting",
)
# Short words that many words of the documents begin with or are.
WHOLE_WORDS = (
    ("articles", ("the", "der", "la", "le", "der an")), ("linking", ("and", "und", "et", "in", "on", "in the")),
)
MARKED_WORDS = ("thea ", "then ", "schei", "queno ")
META_PHRASES = ("license",)
META_TALK = ("This sub is old.", "this submarine", "good karma", "karmas", "see Rule 5", "rule five", "an UPVOTE", "plain")
EMBEDDING = EmbeddingSettings(floor=0.05)
ENCODER_DIM = 64
# The labels of the table of vectors.
EMBEDDING_LABELS = tuple(range(10))
# Arms to compare, and the sources they are compared on.
ARMS = ("en", "de", "fr", "es")
HELD_OUT = ("src1", "src2", "src3")
FLOORS = (0.0, 0.25, 0.5, 0.75)
CONFIG = CurationConfig(
    length=BOUNDS,
    near_dup=NEAR_DUP,
    embedding=EMBEDDING,
    blocklist=BLOCKLIST,
    obfuscations=rules.obfuscation_patterns(BLOCKLIST),
    meta_phrases=META_PHRASES,
    meta_patterns=(),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.read_corpus_parquet(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shared schema, scored by their quality label if any."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        documents(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("source_id"),
            "text",
            F.col("quality").cast("double").alias("score"),
            "source",
        )
    )


def messy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of six kinds of scraping debris added."""
    kind, body = F.col("doc_id") % 6, F.col("text")
    messy = (
        F.when(kind == 0, F.concat(body, F.lit(" see https://example.com/a?b=c and www.example.org now")))
        .when(kind == 1, F.concat(body, F.lit(" \n\n** EDIT 2 : thanks, all\nbye")))
        .when(kind == 2, F.concat(body, F.lit(" what!!!!!! really???? wait.... no,,,, ok!!")))
        .when(kind == 3, F.concat(F.lit("\t "), body, F.lit(" \t\n tabs \r\n and   blanks ")))
        .when(kind == 4, F.concat(F.lit("Tom &amp;amp; Jerry "), body))
        .otherwise(F.concat(F.lit("[Removed] "), body))
    )
    return documents(spark, sf_dir).select("doc_id", messy.alias("text"))


def two_field_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the conversations: each user turn as a title with the answer
    that follows as its body. A turn without a partner has the other field null."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    prompts_ = turns.where("role <> 'assistant'").alias("p")
    following = F.expr("p.conv_id = a.conv_id AND a.turn = p.turn + 1 AND p.role = 'user'")
    titled = prompts_.join(answers.alias("a"), following, "left").select(
        F.concat_ws("-", "p.conv_id", "p.turn").alias("id"),
        F.col("p.text").alias("title"),
        F.col("a.text").alias("selftext"),
    )
    alone = answers.join(asked, ["conv_id", "turn"], "left_anti").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.lit(None).cast("string").alias("title"),
        F.col("text").alias("selftext"),
    )
    return titled.unionByName(alone)


def on_messy(function: Callable[[Column], Column], name: str = "text") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return messy_documents(spark, sf_dir).select(
            "doc_id", function(F.col("text")).alias(name)
        )

    return run


def on_documents(*columns: Callable[[], Column] | str) -> Query:
    """Documents with columns that are made when the query runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = [c if isinstance(c, str) else c() for c in columns]
        return documents(spark, sf_dir).select(*made)

    return run


def filtered(condition: Callable[[Column], Column]) -> Query:
    """Ids of the documents for which `condition` holds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).where(condition(F.col("text"))).select("doc_id")

    return run


class _Buckets(dict):
    """Hash bucket of a word, worked out once per word."""

    def __missing__(self, word: str) -> int:
        self[word] = bucket = hashlib.md5(word.encode()).digest()[0] % ENCODER_DIM
        return bucket


class WordHashEncoder:
    """Counts words per hash bucket: a stand-in for a sentence model that every
    engine can reproduce."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        words, bucket_of = [re.findall(r"\w+", value.lower()) for value in texts], _Buckets()
        row = np.repeat(np.arange(len(texts)), [len(found) for found in words])
        bucket = np.fromiter((bucket_of[w] for found in words for w in found), np.int64, len(row))
        counts = np.bincount(row * ENCODER_DIM + bucket, minlength=len(texts) * ENCODER_DIM)
        return counts.reshape(len(texts), ENCODER_DIM).astype(float)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their keyword tag, which may be empty."""
    return corpus(spark, sf_dir).withColumn("context", tagging.tag_by_keywords(F.col("text")))


def with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag_two_pass(corpus(spark, sf_dir))


# --- sources and sinks -------------------------------------------------------


def csv_copy(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "corpus-csv")
    writer = corpus(spark, sf_dir).write.option("header", True).option("escape", '"')
    writer.option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return path


def read_corpus_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_corpus_csv(spark, csv_copy(spark, sf_dir))


def read_wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file, each split of which cuts its own records."""
    return readers.read_corpus_csv(spark, csv_copy(spark, sf_dir), wide=True)


def skip_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [scratch_path(spark, "never-written"), csv_copy(spark, sf_dir)]
    return readers.load_corpus(spark, paths)


def unify_single_field_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "benchmark")
    return readers.unify_single_field_source(raw, "benchmark", "item_id", "text")


def unify_two_field_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = two_field_posts(spark, sf_dir)
    return readers.unify_two_field_source(
        posts, "conversations", score_column=None, flag_column=None
    )


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (corpus, unify_single_field_source, unify_two_field_source)
    return readers.union_sources([source(spark, sf_dir) for source in sources])


def limit_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (corpus, unify_single_field_source, unify_two_field_source)
    return readers.union_sources(
        [readers.limit_per_source(source(spark, sf_dir), 25) for source in sources]
    )


def top_n_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return select.top_n_by_score(scored, 100, score="n_chars", key=("doc_id",))


def nsfw_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    flagged = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return flagged.select("doc_id", readers.nsfw_flag(F.col("toxic") == 1).alias("nsfw"))


def write_raw_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    writers.write_raw_cached(spark, path, lambda: corpus(spark, sf_dir))

    def never() -> DataFrame:
        raise AssertionError("the table is there and must be reused")

    return writers.write_raw_cached(spark, path, never)


def write_training_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "training")
    rows = materialise(with_fallback(spark, sf_dir), "tagged")
    writers.write_training_jsonl(split.stratified_split(rows), path)
    return spark.read.schema(TRAINING_RECORD).json(path)


def write_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    result = cleaning.clean(corpus(spark, sf_dir), CONFIG)
    cleaning.write_report(result, path)
    report = spark.read.schema(writers.REPORT_SCHEMA).json(path)
    parts = [
        report.select(F.lit(name).alias("part"), F.explode(name).alias("name", "n"))
        for name in ("stats", "context_distribution", "source_distribution")
    ]
    scored = report.select(
        F.lit("with_scores").alias("part"), F.lit("").alias("name"), F.col("with_scores").alias("n")
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(scored)


# --- text --------------------------------------------------------------------


def null_to_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = F.when(F.col("doc_id") % 3 > 0, F.col("text"))
    return documents(spark, sf_dir).select("doc_id", text.null_to_empty(holed).alias("text"))


def unescape_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.unescape_entities(F.col("html")).alias("html"))


def normalise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.normalise_text(F.col("html")).alias("text"))


def fold_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their letters widened, folded back."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    wide = "".join(chr(ord(ch) + 0xFEE0) for ch in letters)
    widened = F.translate("text", letters, wide)
    return documents(spark, sf_dir).select("doc_id", text.fold_unicode(widened).alias("text"))


def strip_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.replace(
        F.replace(F.col("text"), F.lit(" "), F.lit(chr(0x200B))), F.lit("\n"), F.lit(chr(0xA0))
    )
    return documents(spark, sf_dir).select("doc_id", text.strip_invisible(hidden).alias("text"))


def drop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = messy_documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("source_id"),
        "text",
        F.lit(None).cast("double").alias("score"),
        F.lit("documents").alias("source"),
    )
    return cleaning.normalised_with_reason(raw, CONFIG).select("source_id", "reason")


def obfuscation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that still show a blocked word after its letters are swapped."""
    swapped = F.translate("text", "ioea", "103@")
    patterns = rules.obfuscation_patterns(BLOCKLIST)
    return (
        documents(spark, sf_dir)
        .where(rules.has_obfuscated_word(swapped, patterns))
        .select("doc_id")
    )


def meta_post_filter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with some talk about the forum added, under the default rule."""
    said = F.array(*[F.lit(x) for x in META_TALK])
    talk = F.get(said, (F.col("doc_id") % len(META_TALK)).cast("int"))
    noted = documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), talk).alias("text"))
    return noted.where(rules.is_meta_post(F.col("text"))).select("doc_id")


# --- duplicates --------------------------------------------------------------


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_keep_best(corpus(spark, sf_dir), count_as="copies")


def word_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = documents(spark, sf_dir).select(
        "doc_id", shingles.word_shingles(F.col("text")).alias("grams")
    )
    return grams.select(
        "doc_id",
        F.size("grams").alias("n_shingles"),
        F.md5(F.array_join(F.array_sort("grams"), "|")).alias("digest"),
    )


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = shingles.minhash_signature(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(signature.cast("array<string>"), ",").alias("signature")
    )


def lsh_band_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = near_dup.with_band_keys(documents(spark, sf_dir), settings=NEAR_DUP)
    keys = keyed.select("doc_id", F.posexplode_outer("bands").alias("band", "bucket"))
    return keys.where("bucket IS NOT NULL").withColumn("bucket", F.lower(F.hex("bucket")))


def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.lsh_buckets(corpus(spark, sf_dir), settings=NEAR_DUP)


def near_dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = near_dup.drop_near_duplicates(corpus(spark, sf_dir), settings=NEAR_DUP)
    return kept.select("source", "source_id")


def jaccard_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay if a collision must be confirmed by the shingle sets."""
    kept = near_dup.drop_near_duplicates(corpus(spark, sf_dir), settings=replace(NEAR_DUP, verify=True))
    return kept.select("source", "source_id")


def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_clusters(corpus(spark, sf_dir), settings=NEAR_DUP)


# --- tags --------------------------------------------------------------------


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = documents(spark, sf_dir).select(
        "doc_id", tagging.keyword_hits(F.col("text")).alias("hits")
    )
    names = [label for label, _ in lexicons.CONTEXT_KEYWORDS]
    return hits.select(
        "doc_id", *[F.col("hits")[i].alias(name.replace(" ", "_")) for i, name in enumerate(names)]
    )


def keyword_hits_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that end where a word does."""
    hits = tagging.keyword_hits(F.col("text"), WHOLE_WORDS, match="word")
    rows = documents(spark, sf_dir).select("doc_id", hits.alias("hits"))
    return rows.select("doc_id", *[F.col("hits")[i].alias(name) for i, (name, _) in enumerate(WHOLE_WORDS)])


def wordlist_filter_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked words of which those listed with a blank end where a word does."""
    found = rules.has_listed_word(F.col("text"), MARKED_WORDS, match="marked")
    return documents(spark, sf_dir).where(found).select("doc_id")


def tag_by_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("source_id", "context")


def tag_by_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    labels, means = tagging.label_centroids(vectors, "label", "embedding", EMBEDDING_LABELS)
    near = tagging.nearest_label(F.col("embedding"), labels, means)
    return vectors.select("vec_id", near.alias("near")).select("vec_id", "near.*")


def tag_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagging.tag_two_pass(
        corpus(spark, sf_dir), make_encoder=WordHashEncoder, settings=EMBEDDING
    )
    return rows.select("source_id", "context")


def encode_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = tagging.encode_texts(F.col("text"), WordHashEncoder)
    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(vector.cast("array<int>").cast("array<string>"), ",").alias("vector")
    )


def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tag_coverage(tagged(spark, sf_dir))


def tag_precision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagging.tag_two_pass(
        corpus(spark, sf_dir), make_encoder=WordHashEncoder, settings=EMBEDDING
    )
    return reports.tag_precision_report(rows)


# --- reports, split, whole run -----------------------------------------------


def funnel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(corpus(spark, sf_dir), CONFIG).funnel()


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.clean(corpus(spark, sf_dir), CONFIG, WordHashEncoder).rows
    return rows.select("source", "source_id", "score", "context", "text")


def funnel_filters_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(corpus(spark, sf_dir), replace(CONFIG, filters_first=True)).funnel()


def clean_filters_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.clean(corpus(spark, sf_dir), replace(CONFIG, filters_first=True)).rows
    return rows.select("source", "source_id", "score", "text")


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_distribution(with_fallback(spark, sf_dir))


def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_distribution(union_sources(spark, sf_dir))


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_summary(union_sources(spark, sf_dir))


def count_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_with_scores(corpus(spark, sf_dir))


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("n_chars")
    return reports.score_quantiles(scored, "n_chars", cut=5000)


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return split.stratified_split(rows, "lang", ("doc_id",))


# --- scores and samples ------------------------------------------------------


def min_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(rules.has_min_score(F.col("n_chars"), 5000)).select("doc_id")


def nsfw_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    flagged = documents(spark, sf_dir).select("doc_id").join(labels, "doc_id", "left")
    return flagged.where(rules.is_unflagged(F.col("toxic"))).select("doc_id")


def sample_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source")
    return split.sample_per_label(rows, 20, "source", ("doc_id",))


def balance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.balance_labels(documents(spark, sf_dir).select("doc_id", "lang"), "lang", ("doc_id",))


def approx_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.approx_split(documents(spark, sf_dir).select("doc_id"), ("doc_id",))


def similarity_floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    labels, means = tagging.label_centroids(vectors, "label", "embedding", EMBEDDING_LABELS)
    near = tagging.nearest_label(F.col("embedding"), labels, means, floor=-1.0)
    return tagging.similarity_floor_sweep(vectors.select(near.alias("near")).select("near.*"), FLOORS)


def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    labels, means = tagging.label_centroids(vectors, "label", "embedding", EMBEDDING_LABELS)
    names = [int(label) for label in labels]
    score = scoring.relevance_score(F.col("embedding"), F.col("label"), names, means)
    return vectors.select("vec_id", score.alias("relevance"))


def novelty_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.novelty_score(unify_single_field_source(spark, sf_dir), corpus(spark, sf_dir))


def bucket_novelty_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = unify_single_field_source(spark, sf_dir)
    return scoring.bucket_novelty_score(candidates, corpus(spark, sf_dir), near_dup=NEAR_DUP)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers of the conversations, scored by their length."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", scoring.length_score(F.col("text")).alias("score"))


def group_relative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.group_relative_score(answers(spark, sf_dir), ("conv_id",), "score", ("turn",)).select(
        "conv_id", "turn", "relative"
    )


def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = scoring.group_relative_score(answers(spark, sf_dir), ("conv_id",), "score", ("turn",))
    return rated.where("best").select("conv_id", "turn", "score")


def distinct_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.distinct_n(documents(spark, sf_dir), "lang")


def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = documents(spark, sf_dir).select(
        "source", "lang", scoring.length_score(F.col("text")).alias("length"), (F.col("n_chars") / 1000).alias("size")
    )
    return scoring.arm_comparison(rated, "source", "lang", ("length", "size"))


def arm_comparison_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages side by side over three sources."""
    rated = documents(spark, sf_dir).select(
        "source", "lang", "text", scoring.length_score(F.col("text")).alias("length"), (F.col("n_chars") / 1000).alias("size")
    )
    return scoring.compare_arms(rated, "lang", "source", ("length", "size"), ARMS, HELD_OUT)


def _model(spark: SparkSession, sf_dir: str, label: str) -> PipelineModel:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("double").alias("label"))
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return scoring.text_classifier(rows.join(labels.where("label IS NOT NULL"), "doc_id"))


def _probability(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return scoring.with_probability(rows, _model(spark, sf_dir, label), "p")


def train_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probability(spark, sf_dir, "quality").select("doc_id", F.col("p").alias("quality"))


def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probability(spark, sf_dir, "toxic").select("doc_id", F.col("p").alias("toxicity"))


def clean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_score(spark, sf_dir).select("doc_id", (1 - F.col("toxicity")).alias("clean"))


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five parts of the score of the benchmark's items, as candidates beside the
    documents, and their sum under the usual weights."""
    candidates = tagging.tag_two_pass(
        unify_single_field_source(spark, sf_dir), make_encoder=WordHashEncoder, settings=EMBEDDING
    )
    quality, toxic = (_model(spark, sf_dir, label) for label in ("quality", "toxic"))
    return reward.reward(
        candidates, corpus(spark, sf_dir), quality, toxic, WordHashEncoder, embedding=EMBEDDING
    )


def relevance_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each document and the prompt of a label."""
    labels = [label for label in lexicons.LABELS if label != lexicons.FALLBACK_LABEL]
    label = F.array(*map(F.lit, labels))[(F.col("doc_id") % len(labels)).cast("int")]
    score = reward.relevance_to_label(F.col("text"), label, WordHashEncoder, labels, EMBEDDING)
    return documents(spark, sf_dir).select("doc_id", score.alias("relevance"))


# Learned scores, which SQL cannot express.
WITHOUT_SQL = ("train_quality_classifier", "toxicity_score", "clean_score", "composite_score")

QUERIES: dict[str, Query] = {
    "min_score_filter": min_score_filter,
    "nsfw_filter": nsfw_filter,
    "sample_per_label": sample_per_label,
    "balance_labels": balance_labels,
    "approx_split": approx_split,
    "similarity_floor_sweep": similarity_floor_sweep,
    "length_score": on_documents(
        "doc_id", lambda: scoring.length_score(F.col("text")).alias("length")
    ),
    "relevance_score": relevance_score,
    "novelty_score": novelty_score,
    # The same under the name it had beside the form by buckets.
    "exact_novelty_score": novelty_score,
    "bucket_novelty_score": bucket_novelty_score,
    "group_relative_score": group_relative_score,
    "best_of_n": best_of_n,
    "distinct_n": distinct_n,
    "arm_comparison": arm_comparison,
    "train_quality_classifier": train_quality_classifier,
    "toxicity_score": toxicity_score,
    "clean_score": clean_score,
    "composite_score": composite_score,
    "relevance_to_label": relevance_to_label,
    "arm_comparison_held_out": arm_comparison_held_out,
    "funnel_report": funnel_report,
    "clean_corpus": clean_corpus,
    "drop_reason": drop_reason,
    "read_corpus_csv": read_corpus_csv,
    "read_wide_csv": read_wide_csv,
    "read_corpus_parquet": lambda spark, sf_dir: corpus(spark, sf_dir),
    "skip_missing_source": skip_missing_source,
    "limit_per_source": limit_per_source,
    "unify_single_field_source": unify_single_field_source,
    "unify_two_field_source": unify_two_field_source,
    "union_sources": union_sources,
    "top_n_by_score": top_n_by_score,
    "nsfw_flag": nsfw_flag,
    "write_raw_cached": write_raw_cached,
    "write_training_jsonl": write_training_jsonl,
    "write_report_json": write_report_json,
    "null_to_empty": null_to_empty,
    "unescape_entities": unescape_entities,
    "fold_unicode": fold_unicode,
    "strip_invisible": strip_invisible,
    "strip_urls": on_messy(text.strip_urls),
    "strip_edit_note": on_messy(text.strip_edit_note),
    "cap_repeated_punct": on_messy(text.cap_repeated_punct),
    "collapse_whitespace": on_messy(text.collapse_whitespace),
    "normalise_text": on_messy(text.normalise_text),
    "normalise_pages": normalise_pages,
    "word_count": on_documents(
        "doc_id",
        lambda: text.word_count(F.col("text")).alias("n_words"),
        lambda: text.char_count(F.col("text")).alias("n_chars"),
    ),
    "format_prompt": on_documents(
        "doc_id",
        lambda: prompts.format_prompt(F.concat(F.lit("  "), F.upper("lang"))).alias("prompt"),
    ),
    "format_example": on_documents(
        "doc_id",
        lambda: prompts.format_example(F.upper("lang"), F.col("text")).alias("line"),
    ),
    "score_to_int": on_documents(
        "doc_id",
        lambda: prompts.score_to_int(
            F.when(F.col("doc_id") % 4 > 0, F.col("n_chars") / 3)
        ).alias("score"),
    ),
    "is_tombstone": on_messy(rules.is_tombstone, "dead"),
    "is_empty": on_documents(
        "doc_id",
        lambda: rules.is_empty(F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(" \t")).alias(
            "is_empty"
        ),
    ),
    "length_filter": filtered(lambda t: rules.length_ok(t)),
    "length_filter_wide": filtered(lambda t: rules.length_ok(t, BOUNDS)),
    "wordlist_filter_whole_words": filtered(lambda t: rules.has_listed_word(t, BLOCKLIST, "word")),
    "wordlist_filter_marked": wordlist_filter_marked,
    "keyword_hits_whole_words": keyword_hits_whole_words,
    "funnel_filters_first": funnel_filters_first,
    "clean_filters_first": clean_filters_first,
    "strip_edit_note_strict": on_messy(lambda t: text.strip_edit_note(F.concat(F.lit("Credit: "), t), strict=True)),
    "wordlist_filter": filtered(lambda t: rules.has_listed_word(t, BLOCKLIST)),
    "obfuscation_filter": obfuscation_filter,
    "meta_post_filter": filtered(lambda t: rules.is_meta_post(t, META_PHRASES, ())),
    "meta_post_filter_default": meta_post_filter_default,
    "exact_dedup_keep_best": exact_dedup,
    "word_shingles": word_shingles,
    "minhash_signature": minhash_signature,
    "lsh_band_keys": lsh_band_keys,
    "lsh_buckets": lsh_buckets,
    "near_dup_keep_first": near_dup_keep_first,
    "jaccard_verify": jaccard_verify,
    "near_dup_clusters": near_dup_clusters,
    "keyword_hits": keyword_hits,
    "tag_by_keywords": tag_by_keywords,
    "tag_by_embedding": tag_by_embedding,
    "tag_two_pass": tag_two_pass,
    "encode_batch": encode_batch,
    "tag_coverage": tag_coverage,
    "tag_precision_report": tag_precision_report,
    "label_distribution": label_distribution,
    "source_distribution": source_distribution,
    "source_summary": source_summary,
    "count_with_scores": count_with_scores,
    "score_quantiles": score_quantiles,
    "stratified_split": stratified_split,
}
