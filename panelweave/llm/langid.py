"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
likelihood of a word is the sum over all its segmentations into pieces, found by the
forward algorithm; training weighs pieces by forward-backward expectations.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import CACHE_WORDS, crc_mod, freeing, hold, letter_words, slices, whole_texts

#: Characters after which the forward sums of a longer word are scaled, so that they do not vanish.
SCALED = 16
#: Probability of a character that no piece covers.
UNKNOWN = 1e-8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Letters-only pieces, lower case, of a public vocabulary file (a tokenizers JSON or a sentencepiece model)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        byte = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}
        raw = []
        for x in model["vocab"]:
            try:
                raw.append(bytes(byte[c] for c in (x.removesuffix(end) if end else x)).decode())
            except (UnicodeDecodeError, KeyError):
                continue
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [model.id_to_piece(i).replace("▁", "") for i in range(model.get_piece_size())]
    return sorted({x.lower() for x in raw if x.isalpha()})


class Lattice:
    """Finds the pieces in words, all words at once, by rolling hashes of their substrings."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.size, self.longest = pieces, len(pieces), max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.size, np.int32)
        for i, h in enumerate(hashes):
            k = (int(h) * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.ids[k] != self.size:
                k = (k + 1) & ((1 << bits) - 1)
            self.keys[k], self.ids[k] = h, i

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes; the vocabulary's size where there is none."""
        k = ((h * MULTIPLIER) >> self.shift).astype(np.int64)
        out, open_ = np.full(h.shape, self.size, np.int32), np.arange(h.size)
        flat, out_flat, k = h.ravel(), out.ravel(), k.ravel()
        while open_.size:
            ids, same = self.ids[k[open_]], self.keys[k[open_]] == flat[open_]
            out_flat[open_] = np.where(same, ids, self.size)
            open_ = open_[~same & (ids != self.size)]
            k[open_] = (k[open_] + 1) & (self.keys.size - 1)
        return out_flat.reshape(h.shape)

    def words(self, words: list[str]):
        """For groups of words of one length: (indexes into words, array [start, length-1, word] of piece numbers)."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(length):
            if not n:
                continue
            same = np.flatnonzero(length == n)
            most = min(int(n), self.longest)
            for at in np.array_split(same, max(1, len(same) * int(n) * most // 800_000)):
                c = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).T.astype(np.uint64) + np.uint64(1)
                found = np.full((n, most, len(at)), self.size, np.int32)
                h = np.zeros_like(c)
                with np.errstate(over="ignore"):
                    for m in range(most):
                        h = h[: n - m] * MULTIPLIER + c[m:]
                        found[: n - m, m] = self.find(h)
                yield at, found

    def forward(self, found: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha, logs)[end, word] of one language: alpha * exp(logs) is the summed probability of all segmentations up to each end."""
        n, longest, words = found.shape
        alpha, logs = np.zeros((n + 1, words)), np.zeros((n + 1, words))
        alpha[0] = 1
        for start in range(n):
            if start and start % SCALED == 0:
                scale = alpha[start].copy()
                alpha[start : start + longest] /= scale
                logs[start:] += np.log(scale)
            alpha[start + 1] += alpha[start] * UNKNOWN
            for m in range(min(longest, n - start)):
                alpha[start + m + 1] += alpha[start] * p[found[start, m]]
        return alpha, logs

    def expected(self, found: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each word with its weight."""
        n, longest, words = found.shape
        alpha, logs = self.forward(found, p)
        beta, back = np.zeros((n + 1, words)), np.zeros((n + 1, words))
        beta[n] = 1
        for start in range(n - 1, -1, -1):
            if start < n - 1 and (n - 1 - start) % SCALED == 0:
                scale = beta[start + 1].copy()
                beta[start + 1 : start + 1 + longest] /= scale
                back[: start + 1 + longest] += np.log(scale)
            beta[start] = beta[start + 1] * UNKNOWN
            for m in range(min(longest, n - start)):
                beta[start] += p[found[start, m]] * beta[start + m + 1]
        out, total = np.zeros(self.size + 1), np.log(np.maximum(alpha[n], 1e-300)) + logs[n]
        for start in range(n):
            for m in range(min(longest, n - start)):
                share = weight * np.exp(logs[start] + back[start + m + 1] - total) if n > SCALED else weight / np.maximum(alpha[n], 1e-300)
                out += np.bincount(found[start, m], alpha[start] * p[found[start, m]] * beta[start + m + 1] * share, self.size + 1)
        out[self.size] = 0
        return out


def word_scores(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language) for words and languages."""
    out = np.zeros((len(words), len(p)))
    for at, found in lattice.words(words):
        for k in range(len(p)):
            alpha, logs = lattice.forward(found, p[k])
            out[at, k] = np.log(np.maximum(alpha[-1], 1e-300)) + logs[-1]
    return out


class Model:
    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray, prior: np.ndarray):
        self.languages, self.pieces, self.p, self.prior = languages, pieces, p, prior


def train(docs: DataFrame, *, vocabulary_path: str, held_out=None, sample_rows: int = 3000, rounds: int = 3, id_column: str = "doc_id") -> Model:
    """Piece probabilities of each language from rows with a language, apart from the held-out ones.

    sample_rows bounds the rows a language gives (in expectation: rows are taken by a hash of the
    id). Word counts and expectations are Spark aggregations; the driver gets one number for each
    language and piece of the fixed vocabulary. No labelled row, or an empty table: a model without languages. Null texts teach nothing.
    """
    spark = docs.sparkSession
    base = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        base = base.filter(~F.coalesce(held_out, F.lit(False)))
    sizes = {r[0]: r[1] for r in base.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = vocabulary(vocabulary_path)
    if not languages:
        return Model([], pieces, np.zeros((0, len(pieces) + 1)), np.zeros(0))
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, min(1.0, sample_rows / sizes[name])).otherwise(rate)
    sample = base.filter(F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(1_000_000)) < rate * 1_000_000).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                words, codes, offsets = letter_words(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                of = np.repeat(np.asarray(langs.indices), np.diff(offsets))
                pair, n = np.unique(of.astype(np.int64) * len(words) + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))), pa.array(n)], ["lang", "word", "n"])

    counts = sample.mapInArrow(freeing(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).filter("word <> ''")
    counts = hold(counts, "language-words")
    lattice, known = Lattice(pieces), {name: k for k, name in enumerate(languages)}
    p = np.full((len(languages), len(pieces) + 1), 1.0 / len(pieces))
    p[:, -1] = 0
    for _ in range(rounds):

        def expect(batches, p=p):
            total = np.zeros_like(p)
            for batch in batches:
                langs, words, n = batch.column("lang").to_pylist(), batch.column("word").to_pylist(), np.asarray(batch.column("n"))
                k = np.array([known[x] for x in langs], np.int64)
                for at_language in range(len(languages)):
                    rows = np.flatnonzero(k == at_language)
                    weight = n[rows].astype(float)
                    for at, found in lattice.words([words[i] for i in rows]):
                        total[at_language] += lattice.expected(found, p[at_language], weight[at])
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(piece), pa.array(total[k, piece])], ["language", "piece", "n"])

        rows = counts.mapInArrow(freeing(expect), "language long, piece long, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros_like(p)
        n[rows.language.to_numpy(np.int64), rows.piece.to_numpy(np.int64)] = rows.n
        n[:, :-1] += 0.02
        p = n / n.sum(axis=1, keepdims=True)
        p[:, -1] = 0
    prior = np.log(np.full(len(languages), 1.0 / len(languages)))
    return Model(languages, pieces, p, prior)


def predict(docs: DataFrame, model: Model, *, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score (posterior of the predicted language) of each whole text.

    Null or letterless texts, and all texts under a model without languages, give `und` with
    score 0. Words unknown to every language count alike for each; of languages that score alike the first by name wins.
    Repeated rows stay repeated, an empty table gives no rows. keep: columns that stay (with `text`, null as the empty text);
    others, however named, go. Texts and words of any length are scored whole.
    """
    rows = whole_texts(docs, id_column, *(c for c in keep if c != "text"))
    languages, pieces, p, prior = model.languages, model.pieces, model.p, model.prior
    head = [f for f in rows.schema if f.name != "text" or "text" in keep]

    def score(batches):
        lattice, seen, table = Lattice(pieces), {}, np.zeros((0, len(languages)))
        for batch in batches:
            for part in slices(batch):
                words, codes, offsets = letter_words(part.column("text"))
                words = words.to_pylist()
                if len(seen) > CACHE_WORDS:
                    seen, table = {}, table[:0]
                new = list(dict.fromkeys(w for w in words if w not in seen))
                seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
                if new:
                    table = np.concatenate([table, word_scores(lattice, p, new)])
                at = np.fromiter((seen[w] for w in words), np.int64, len(words))
                real = np.array([bool(w) for w in words])
                total, lettered = np.zeros((part.num_rows, len(languages))), np.zeros(part.num_rows)
                of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                if len(codes):
                    for k in range(len(languages)):
                        total[:, k] = np.bincount(of, (table[at, k] * real)[codes], part.num_rows)
                    lettered = np.bincount(of, real[codes], part.num_rows)
                sure = (lettered > 0) & bool(languages)
                if languages:
                    total += prior
                    total -= total.max(axis=1, keepdims=True)
                    post = np.exp(total)
                    post /= post.sum(axis=1, keepdims=True)
                    best = post.argmax(axis=1)
                    top = post[np.arange(len(best)), best]
                    name = np.where(sure, np.array([*languages], object)[best], "und")
                else:
                    top, name = np.zeros(part.num_rows), np.full(part.num_rows, "und", object)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in head), pa.array(name, pa.string()), pa.array(np.where(sure, top, 0.0))], [*(f.name for f in head), "lang_pred", "score"])

    from pyspark.sql import types as T

    return rows.mapInArrow(freeing(score), T.StructType([*head, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_column: str = "doc_id"):
    return crc_mod(id_column, 4) == 2
