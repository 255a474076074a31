"""URL filters: explicit rules, then naive Bayes over segmented host words and path tokens.

Names that are written together in a host are split by the most probable sequence of dictionary words (unigram
Viterbi). Word counts are taken over all given texts. A multinomial naive Bayes model learns from the URLs that a rule
decides and judges the others. The top-level label and the path's first step name the rules themselves, but are tokens
like others; hosts' words and paths decide where no rule does.

Nulls and ties: a null URL, or one without `://`, has empty host and path; it meets no rule and is judged by the prior
alone. Of fitting rules the longest wins. With no URL decided by a rule, or at equal scores, the verdict is allow.
Repeated rows and repeated or null ids each get a row. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.llm import words as W
from arealis.llm.batches import stored

NOT_LETTERS = W._table(bytes([*range(0x00, 0x61), *range(0x7B, 0x80)]))


#: Letters of a dictionary word that a name is asked for.
HEAD = 8


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.col(url) if isinstance(url, str) else url
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, else null. rules: host/path to verdict."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        of, _, at = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{at}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: lower-cased words of ASCII letters or other alphabets in all texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(rows, 0, 4 << 20):
            w = W.words_of(b.column(0), NOT_LETTERS, lower=True)
            _, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([w.bytes_of(i).decode("utf-8", "replace") for i in first], pa.string()), pa.array(n)], ["word", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most probable split. found: (place, length, count) of the dictionary words in the name. Any other run of
    letters has the probability of a word seen once, over 26 for each letter. Of equal splits the one with the longer last word."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for at, size, n in sorted(found):
        ends.setdefault(at + size, []).append((at, math.log(n / total)))
    best, back, rare, letter = [0.0], [0], -math.log(total), -math.log(26.0)
    run, begin = -math.inf, 0  # the best split whose last part is no word and ends here
    for i in range(1, len(name) + 1):
        if best[i - 1] + rare > run:
            run, begin = best[i - 1] + rare, i - 1
        run += letter
        top, source = -math.inf, 0
        for at, weight in ends.get(i, []):
            if best[at] + weight > top:
                top, source = best[at] + weight, at
        if run > top:
            top, source = run, begin
        best.append(top)
        back.append(source)
    out, i = [], len(name)
    while i:
        out.append(name[back[i] : i])
        i = back[i]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words for distinct names of letters (column name). Names and dictionary words may have any length: from each of
    its places a name asks for its next 1 to HEAD letters; dictionary words that begin with HEAD of them are then compared with
    the name. So a name has some rows for each letter, and the plan doesn't depend on the lengths."""
    counts = stored(counts.withColumn("key", F.left("word", F.lit(HEAD))), "words")
    names = stored(names.withColumn("id", F.monotonically_increasing_id()), "names")
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    heads = names.select("id", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    heads = heads.select("id", "at", F.col("name").substr(F.col("at"), F.lit(HEAD)).alias("head"))
    parts = heads.select("id", "at", F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda k: F.left("head", k))).alias("key"))
    long = F.length("key") == HEAD
    found = parts.join(counts, "key").select("id", F.struct("at", F.length("word").alias("size"), "n", F.when(long, F.col("word")).alias("word")).alias("arc"))
    arcs = found.groupBy("id").agg(F.collect_list("arc").alias("arcs"))  # of one name

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            names, words = b.column(0).to_pylist(), []
            for name, arcs in zip(names, b.column(1).to_pylist(), strict=True):
                fit = [(a["at"] - 1, a["size"], a["n"]) for a in arcs or [] if a["word"] is None or name.startswith(a["word"], a["at"] - 1)]
                words.append(viterbi(name, fit, total))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return names.join(arcs, "id", "left").select("name", "arcs").mapInArrow(run, "name string, words array<string>")


def judge(pages: DataFrame, texts: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, log_odds (of block against allow; null where a rule decides)."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, verdict).otherwise(ruled)
    rows = rows.withColumn("ruled", ruled)
    urls = stored(rows.groupBy("host", "path", "ruled").agg(F.count("*").alias("n")), "urls")

    hosts = urls.select("host").distinct()
    split = hosts.select("host", F.explode(F.split("host", "[^\\p{Ll}]+")).alias("name")).where("name <> ''")
    words = segmented(split.select("name").distinct(), word_counts(texts, text_col))
    host_words = stored(split.join(words, "name").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words")), "host-words")
    steps = F.filter(F.split(F.lower("path"), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    steps = F.transform(steps, lambda x: F.concat(F.lit("/"), F.regexp_replace(x, "\\p{N}+", "#")))
    tokens = urls.join(host_words, "host", "left").select("host", "path", "ruled", "n", F.explode(F.concat(F.coalesce("words", F.array().cast("array<string>")), steps)).alias("token"))
    tokens = stored(tokens, "url-tokens")

    block, allow = (F.coalesce(F.sum(F.when(F.col("ruled") == v, F.col("n"))), F.lit(0)) for v in ("block", "allow"))
    counts = stored(tokens.groupBy("token").agg(block.alias("b"), allow.alias("a")), "token-counts")
    b, a, v = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    pb, pall = urls.agg(F.coalesce(F.sum(F.when(F.col("ruled") == "block", F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("ruled").isNotNull(), F.col("n"))), F.lit(0))).first()
    prior = math.log((pb + 1) / (pall - pb + 1)) if pall else -1.0
    weights = counts.select("token", (F.log((F.col("b") + 1) / (b + v + 1)) - F.log((F.col("a") + 1) / (a + v + 1))).alias("w"))
    odds = tokens.where("ruled is null").join(weights, "token").groupBy("host", "path").agg(F.sum("w").alias("w"))
    odds = stored(odds, "url-odds")
    judged = rows.join(odds, ["host", "path"], "left")
    log_odds = F.when(F.col("ruled").isNull(), F.lit(prior) + F.coalesce("w", F.lit(0.0)))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(log_odds > 0, "block").otherwise("allow")).alias("verdict"), log_odds.alias("log_odds"))
