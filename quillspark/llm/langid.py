"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces (forward algorithm); a text's is the product over its words. Words are scored once per
batch, all words and languages together, and the sums for the texts are gathered from them. A word of any length, such as
a text without spaces, is summed over whole: a window as wide as the longest piece moves over it, rescaled as it goes.

Training: labelled documents, at most PER_LANGUAGE of each language by the order of a hash (the bound of the sample); the
pieces that the vocabulary's own segmentation finds in them are counted. Scoring covers whole texts of all documents.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every text if no row is labelled;
null labels are never learned; ties go to the first language by code point; equal rows stay; an empty table gives an
empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, hash60
from .tokens import held, slices, vocabulary_path

PER_LANGUAGE, SMOOTHING = 4000, 0.5
#: Words up to SHORT characters are scored without rescaling; a character outside the vocabulary has this probability.
SHORT, UNKNOWN = 32, 1e-6
#: Bytes of text, and characters of long words, that a worker scores at a time.
SLICE, LONG_CHARS = 3_000_000, 200_000
#: Rows of an Arrow batch.
ROWS = 1000
UND = "und"
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SLOTS = 20


def held_out(doc_id):
    """A fifth of the documents, by the CRC-32 of doc_id as text; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


class Pieces:
    """The vocabulary: piece numbers of substrings, found by a rolling hash in two open tables."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        texts = {self.model.id_to_piece(i): i for i in range(self.size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.longest = max(map(len, texts))
        self.tables, rest = [], list(texts.items())
        for factor in _FACTORS:
            keys, values, later = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32), []
            for text, i in rest:
                h = 0
                for c in text:
                    h = (h * 1_000_003 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                slot = ((h * int(factor)) & 0xFFFFFFFFFFFFFFFF) >> (64 - _SLOTS)
                if values[slot] < 0:
                    keys[slot], values[slot] = h, i
                else:
                    later.append((text, i))
            self.tables.append((factor, keys, values))
            rest = later
        self.rest = {}
        for text, i in rest:  # the few that both tables were full for
            h = 0
            for c in text:
                h = (h * 1_000_003 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.rest[h] = i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        for factor, keys, values in self.tables:
            slot = (h * factor) >> np.uint64(64 - _SLOTS)
            out = np.where((out < 0) & (keys[slot] == h), values[slot], out)
        for k, i in self.rest.items():
            out[h == np.uint64(k)] = i
        return out


def pieces(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in lower case, where each text's begin)."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column, "")))
    return parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def log_forward(texts: list[str], probability: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """[text, language] log of the sum over all segmentations. probability: [piece, language], with a row at the end for
    what is no piece."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), probability.shape[1]))
    for n in np.unique(lengths[lengths <= SHORT]):
        own = np.flatnonzero(lengths == n)
        chars = np.frombuffer("".join([texts[i] for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n).astype(np.uint64)
        alpha = np.zeros((n + 1, len(own), probability.shape[1]))
        alpha[0] = 1
        for i in range(n):
            h = np.zeros(len(own), np.uint64)
            for j in range(i, min(n, i + vocabulary.longest)):
                h = h * np.uint64(1_000_003) + chars[:, j] + np.uint64(1)
                found = vocabulary.find(h)
                if j == i:
                    alpha[j + 1] += alpha[i] * np.where((found >= 0)[:, None], probability[found], UNKNOWN)
                else:
                    some = np.flatnonzero(found >= 0)
                    alpha[j + 1][some] += alpha[i][some] * probability[found[some]]
        out[own] = np.log(alpha[n])
    long = np.flatnonzero(lengths > SHORT)
    long = long[np.argsort(-lengths[long], kind="stable")]
    ends = np.cumsum(lengths[long])
    for own in np.split(long, np.flatnonzero(np.diff(ends // LONG_CHARS)) + 1) if len(long) else ():
        out[own] = _log_forward_long([texts[i] for i in own], probability, vocabulary)
    return out


def _log_forward_long(texts: list[str], probability: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """The same for long texts, longest first, position by position for all of them together: of the sums only those
    as far back as a piece may reach are kept, and they are divided by the last one, whose logarithm is added up."""
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths) - lengths
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(begins + lengths, lengths) - np.arange(len(chars))  # characters up to the text's end
    longest = vocabulary.longest
    pieces_at = np.full((len(chars), longest), -1, np.int32)  # [last character, length - 1]
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, min(longest, int(lengths[0])) + 1):
        fits = len(chars) - n + 1
        h = h[:fits] * np.uint64(1_000_003) + chars[n - 1 :] + np.uint64(1)
        pieces_at[n - 1 :, n - 1] = np.where(left[:fits] >= n, vocabulary.find(h), -1)
    table = np.concatenate([probability[:-1], np.zeros((1, probability.shape[1])), np.full((1, probability.shape[1]), UNKNOWN)])
    pieces_at[pieces_at < 0] = len(table) - 2
    alone = pieces_at[:, 0]
    alone[alone == len(table) - 2] = len(table) - 1
    back = np.zeros((len(texts), longest, probability.shape[1]))
    back[:, 0] = 1
    total = np.zeros((len(texts), probability.shape[1]))
    for j in range(int(lengths[0])):
        active = int(np.searchsorted(-lengths, -j, side="left"))
        new = (back[:active] * table[pieces_at[begins[:active] + j]]).sum(1)
        total[:active] += np.log(new)
        back[:active, 1:] = back[:active, :-1] / new[:, None]
        back[:active, 0] = 1
    return total


def train(labelled: DataFrame, path: str, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, [piece + 1, language] probabilities) from (doc_id, text, lang). The driver gets a count for each
    piece and language: bounded by the vocabulary and the languages, whatever the input."""
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    totals = {x["lang"]: x["n"] for x in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return [], np.zeros((0, 0))
    # a hash below the language's share keeps about per_language of it, without a sort
    shares = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])
    sample = known.filter(hash60(F.col("doc_id")) / float(1 << 60) < F.element_at(shares, F.col("lang")))
    languages = sorted(totals)

    def count(batches):
        v = pieces(path)
        sums = np.zeros((len(languages), v.size), np.int64)
        for b in slices(batches, "text", SLICE):
            for k, name in enumerate(languages):
                words, _ = _words(b.filter(pc.equal(b.column("lang"), name)).column("text"))
                if len(words):
                    kinds = words.value_counts()
                    found = v.model.encode(kinds.field("values").to_pylist(), num_threads=1)
                    times = np.repeat(kinds.field("counts").to_numpy(), [len(x) for x in found])
                    sums[k] += np.bincount(np.fromiter((i for x in found for i in x), np.int64, len(times)), times, v.size).astype(np.int64)
        lang, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(sums[lang, piece])], ["lang", "piece", "n"])

    rows = sample.select("text", "lang").mapInArrow(count, "lang long, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((pieces(path).size + 1, len(languages)))
    for x in rows:
        counts[x["piece"], x["lang"]] = x["n"]
    counts[:-1] += SMOOTHING
    counts /= counts.sum(0)
    counts[-1] = UNKNOWN
    return languages, counts


def score_texts(column: pa.Array, model: tuple[list[str], np.ndarray], path: str) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    languages, probability = model
    names, score = [UND] * len(column), np.zeros(len(column))
    words, offsets = _words(column)
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if languages and len(words):
        kinds = words.dictionary_encode()
        of_word = log_forward(["▁" + w for w in kinds.dictionary.to_pylist()], probability, pieces(path))
        index, total = kinds.indices.to_numpy(), np.zeros((len(column), len(languages)))
        some = np.flatnonzero(np.diff(offsets))
        for k in range(len(languages)):
            total[some, k] = np.add.reduceat(of_word[index, k], offsets[:-1][some])
        best = total.argmax(1)
        top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        names = [languages[k] if x else UND for k, x in zip(best, letters, strict=True)]
        score = np.where(letters, top, 0.0)
    return names, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of lang_pred among the languages) of every document."""

    def run(batches):
        for b in slices(batches, "text", SLICE):
            names, score = score_texts(b.column("text"), model, path)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _learned(docs: DataFrame, path: str, per_language: int) -> tuple[list[str], np.ndarray]:
    batches_of(docs.sparkSession, ROWS)
    return train(docs.filter(~held_out(F.col("doc_id"))), path, per_language)


def identify(docs: DataFrame, path: str | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from the labelled documents that aren't held out, and predicts all."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    return predict(docs, _learned(docs, path, per_language), path)


def keep_identified(docs: DataFrame, path: str | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows that have a language, with all their columns: one pass, without a shuffle."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    model = _learned(docs, path, per_language)

    def run(batches):
        for b in slices(batches, "text", SLICE):
            names, _ = score_texts(b.column("text"), model, path)
            yield b.filter(pa.array([x != UND for x in names]))

    return docs.mapInArrow(run, docs.schema)
