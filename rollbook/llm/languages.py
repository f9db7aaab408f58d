"""Languages of documents and of their segments by nearest centroid.

Texts are cut into sentences; each sentence is a TF-IDF vector of hashed character n-grams (1 to 4),
normalised, and compared by cosine with several centroids per language. A sentence whose best cosine
lies below its language's floor is rejected (no language). Document frequencies are counted over the
whole corpus. Centroids are fitted on at most ``SAMPLE`` labelled documents per language, chosen by
hash; wrong labels in the sample are cleaned by refitting without the sentences that disagree.
Sentences are classified in Arrow batches with dense matrix products; nothing is done per character
in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents per language that the centroids are fitted on.
SAMPLE = 400
#: Characters up to which a document may be in that sample; the sample holds whole texts.
LONGEST = 20_000
#: Centroids per language, and how far each is drawn to the mean of its language, so that no centroid
#: stands for one odd sentence.
CENTROIDS = 32
SHRINK = 0.5
DIM = 4096
BATCH = 512
#: A sentence counts as one of its own language with so many words (or letters where words are not spaced) ...
WORDS, LETTERS = 4, 6
#: ... and this lead in cosine over every other language.
LEAD = 0.04
#: Cosine floor of a language: this part of the 1st percentile over its training sentences.
FLOOR_PART = 0.6

# Names and three-letter codes of languages as labels write them.
NAMES = {
    "english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "french": "fr", "francais": "fr", "français": "fr", "fra": "fr", "fre": "fr",
    "spanish": "es", "espanol": "es", "español": "es", "spa": "es", "portuguese": "pt", "portugues": "pt", "português": "pt", "por": "pt", "italian": "it", "italiano": "it", "ita": "it",
    "dutch": "nl", "nederlands": "nl", "nld": "nl", "dut": "nl", "russian": "ru", "русский": "ru", "rus": "ru", "chinese": "zh", "中文": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "mandarin": "zh",
    "japanese": "ja", "jpn": "ja", "korean": "ko", "kor": "ko", "polish": "pl", "pol": "pl", "swedish": "sv", "swe": "sv", "turkish": "tr", "tur": "tr", "arabic": "ar", "ara": "ar",
}
# Labels that name no language.
NO_LANGUAGE = ("", "und", "xx", "n/a", "na", "unknown", "none", "null", "mul", "zxx", "mis", "other", "?", "-")

_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+|<[^<>]{1,200}>|&[a-z#0-9]{2,8};|[{\[]\s*\"[^\n]*|```.*?```|[\w-]+(?:\.[\w-]+)+/\S*", re.S)
_ENDS = re.compile(r"(?<=[.!?…])[\s\"'”’»)]+|(?<=[。！？])\s*|[\r\n\u2028\u2029]+|\s*\|\s*")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af豈-\ufaff]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_LETTER = re.compile(r"[^\W\d_]")


def label_code(c: Column) -> Column:
    """Two-letter code that a label names; null where it names none."""
    s = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    head = F.regexp_extract(s, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    code = F.coalesce(names[s], names[head], F.when(F.length(head) == 2, head))
    return F.when(s.isin(*NO_LANGUAGE) | head.isin("xx", "na"), None).otherwise(code)


def segments(text: str | None) -> list[tuple[int, str]]:
    """(position, sentence) of the sentences that have words; noise such as addresses and markup is cut out."""
    if not text:
        return []
    out = []
    for k, part in enumerate(_ENDS.split(_NOISE.sub(" ", text))):
        if part and _LETTER.search(part):
            out.append((k, part.strip()))
    return out


def own(sentence: str) -> bool:
    """Long enough, and enough of it letters, to count as a whole sentence."""
    wide = len(_WIDE.findall(sentence))
    if wide >= LETTERS:
        return True
    letters = len(_LETTER.findall(sentence))
    return len(_WORD.findall(sentence)) >= WORDS and letters >= 0.55 * len(re.sub(r"\s", "", sentence))


def grams(sentences: list[str]) -> np.ndarray:
    """Counts of hashed n-grams: one row per sentence."""
    m = np.zeros((len(sentences), DIM), dtype=np.float32)
    if not sentences:
        return m
    # one array of code points; digits and signs become blanks, runs of blanks one blank
    joined = "\n".join(" " + re.sub(r"[\W\d_]+", " ", s.lower()).strip() + " " for s in sentences)
    cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    row = np.cumsum(cp == 10)
    flat = np.zeros(len(sentences) * DIM, dtype=np.float32)
    h = cp.copy()
    for n in range(1, 5):
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B1) + cp[n - 1 :] if len(h) > 1 else h[:0]
        k = len(cp) - n + 1
        if k <= 0:
            break
        ok = (row[:k] == row[n - 1 : n - 1 + k]) & (cp[:k] != 10)
        x = h[:k][ok] + np.uint64(n * 7919)
        x = (x ^ (x >> np.uint64(15))) * np.uint64(0x2C1B3C6D)
        slot = ((x ^ (x >> np.uint64(12))) % np.uint64(DIM)).astype(np.int64)
        flat += np.bincount(row[:k][ok] * DIM + slot, minlength=len(flat)).astype(np.float32)
    return flat.reshape(len(sentences), DIM)


def vectors(sentences: list[str], idf: np.ndarray) -> np.ndarray:
    m = np.sqrt(grams(sentences)) * idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each hashed n-gram, over all documents; DIM numbers reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for b in batches:
            texts = [t for t in b["text"] if t and _LETTER.search(t)]
            for i in range(0, len(texts), 256):
                df += (grams([_NOISE.sub(" ", t).replace("\n", " ") for t in texts[i : i + 256]]) > 0).sum(axis=0)
            n += len(texts)
        yield pd.DataFrame({"slot": np.arange(-1, DIM), "n": np.concatenate([[n], df])})

    rows = docs.select("text").mapInPandas(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM)
    total = 0
    for r in rows:
        if r["slot"] < 0:
            total = r["n"]
        else:
            df[r["slot"]] = r["n"]
    return df, total


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded by farthest points."""
    c = [x.mean(axis=0)]
    near = x @ (c[0] / max(np.linalg.norm(c[0]), 1e-9))
    while len(c) < min(k, len(x)):
        c.append(x[int(near.argmin())])
        near = np.maximum(near, x @ c[-1])
    c = np.stack(c)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        at = (x @ c.T).argmax(axis=1)
        c = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


class Model:
    """Centroids, their languages, and each language's cosine floor."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, owner: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centroids, self.owner, self.floors = idf, langs, centroids, owner, floors

    def scores(self, sentences: list[str]) -> np.ndarray:
        """Best cosine of each sentence with each language."""
        out = np.zeros((len(sentences), len(self.langs)), dtype=np.float32)
        for i in range(0, len(sentences), BATCH):
            s = vectors(sentences[i : i + BATCH], self.idf) @ self.centroids.T
            for k in range(len(self.langs)):
                out[i : i + BATCH, k] = s[:, self.owner == k].max(axis=1)
        return out


def _shape(sentence: str) -> str:
    """A sentence without what varies between its repeats: numbers and capitalised words."""
    return re.sub(r"[\W\d_]+", " ", re.sub(r"\b[A-Z][\w'’-]*", "", sentence)).strip() or sentence


def fit(sample: list[tuple[str, str]], df: np.ndarray, total: int) -> Model:
    """Fit on (language, text), whose labels may be wrong.

    Sentences of one shape vote on their language; then, twice, sentences that another language's
    single centroid claims are dropped; what is left is clustered into several centroids per language.
    """
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 0.05
    votes: dict[str, dict[str, int]] = {}
    texts: dict[tuple[str, str], str] = {}
    for lang, t in sample:
        for _, s in segments(t):
            if own(s):
                k = _shape(s)
                votes.setdefault(k, {}).setdefault(lang, 0)
                votes[k][lang] += 1
                texts.setdefault((k, lang), s)
    sents = []
    for k, v in sorted(votes.items()):
        lang, n = max(v.items(), key=lambda x: (x[1], x[0]))
        if n > 0.6 * sum(v.values()):
            sents.append((lang, texts[k, lang], n))
    langs = sorted({lang for lang, _, _ in sents})
    if not langs:
        return Model(idf, [], np.zeros((0, DIM), dtype=np.float32), np.zeros(0, dtype=int), np.zeros(0))
    y = np.array([langs.index(lang) for lang, _, _ in sents])
    w = np.sqrt(np.array([n for _, _, n in sents], dtype=np.float32))[:, None]
    x = np.concatenate([vectors([s for _, s, _ in sents[i : i + BATCH]], idf) for i in range(0, len(sents), BATCH)])
    keep = np.ones(len(y), dtype=bool)
    for _ in range(2):
        one = np.stack([(x * w)[keep & (y == k)].sum(axis=0) if (keep & (y == k)).any() else np.zeros(DIM, dtype=np.float32) for k in range(len(langs))])
        one /= np.maximum(np.linalg.norm(one, axis=1, keepdims=True), 1e-9)
        keep = (x @ one.T).argmax(axis=1) == y
    parts = []
    for k in range(len(langs)):
        if (keep & (y == k)).any():
            c = (1 - SHRINK) * _kmeans(x[keep & (y == k)], CENTROIDS) + SHRINK * one[k]
            parts.append((k, c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)))
    cent = np.concatenate([c for _, c in parts])
    owner = np.concatenate([np.full(len(c), k) for k, c in parts])
    cos = x @ cent.T
    best = np.stack([cos[:, owner == k].max(axis=1) if (owner == k).any() else np.full(len(x), -1.0) for k in range(len(langs))], axis=1)
    floors = np.array([FLOOR_PART * np.quantile(best[keep & (y == k), k], 0.01) if (keep & (y == k)).any() else 1.0 for k in range(len(langs))])
    return Model(idf, langs, cent, owner, floors)


def train(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """Document frequencies over all documents; centroids on at most ``per_language`` labelled documents per language."""
    df, total = document_frequencies(docs)
    sized = (F.length("text") > 40) & (F.length("text") <= LONGEST)
    labelled = docs.where(sized).select(label_code(F.col("lang")).alias("lang"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("o")).where("lang is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o"))
    rows = labelled.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "text").collect()
    return fit([(r["lang"], r["text"]) for r in rows], df, total)


_SEGMENT = "doc_id bigint, label string, pos int, chars int, lang string, confidence double, whole boolean"


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, label, pos, chars, lang, confidence, whole): every sentence with words.

    ``lang`` is null for rejected sentences; ``confidence`` is the softmax over languages of the cosine
    at a fixed scale; ``whole`` tells that the sentence is long and clear enough to stand alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x centroids numbers, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            ids, labels, pos, sents = [], [], [], []
            for doc_id, label, text in zip(b["doc_id"], b["label"], b["text"]):
                for k, s in segments(text):
                    ids.append(doc_id), labels.append(label), pos.append(k), sents.append(s)
            if not sents or not m.langs:
                continue
            code, distinct = pd.factorize(pd.Series(sents, dtype=object))
            distinct = list(distinct)
            sc = m.scores(distinct)
            order = np.sort(sc, axis=1)
            best = sc.argmax(axis=1)
            top = sc[np.arange(len(sc)), best]
            lead = top - (order[:, -2] if sc.shape[1] > 1 else 0)
            e = np.exp(25 * (sc - top[:, None]))
            conf = 1 / e.sum(axis=1)
            lang = np.where(top >= m.floors[best], np.array(m.langs, dtype=object)[best], None)
            whole = np.array([own(s) for s in distinct]) & (lead >= LEAD) & (top >= m.floors[best])
            yield pd.DataFrame({"doc_id": ids, "label": labels, "pos": pos, "chars": [len(s) for s in sents], "lang": lang[code], "confidence": conf[code].astype(float), "whole": whole[code]})

    return docs.select("doc_id", label_code(F.col("lang")).alias("label"), "text").mapInPandas(run, _SEGMENT)


def by_document(segs: DataFrame) -> DataFrame:
    """(doc_id, label, main, confidence, langs): the main language of each document with words, and all
    languages used for a whole sentence or more."""
    per = segs.where("lang is not null").groupBy("doc_id", "lang").agg(
        F.first("label").alias("label"),
        F.sum(F.col("chars") * F.col("confidence")).alias("mass"),
        F.max("whole").alias("whole"),
    )
    return per.groupBy("doc_id").agg(
        F.first("label").alias("label"),
        F.max_by("lang", F.struct(F.col("whole"), F.col("mass"), F.col("lang"))).alias("main"),
        (F.max_by("mass", F.struct(F.col("whole"), F.col("mass"), F.col("lang"))) / F.sum("mass")).alias("confidence"),
        F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("lang")))).alias("langs"),
    )


def found(per_doc: DataFrame) -> DataFrame:
    """(doc_id, lang): the language of documents whose label is missing or wrong, all languages of mixed ones.

    Texts that are null, empty or without words have no rows. Rows that share a ``doc_id`` are one document.
    """
    wrong = F.col("label").isNull() | (F.col("label") != F.col("main"))
    langs = F.when(F.size("langs") > 1, F.col("langs")).when(wrong, F.array("main"))
    return per_doc.select("doc_id", F.explode(langs).alias("lang"))
