"""Token counts: count-only Viterbi over the matches that an Aho-Corasick automaton enumerates."""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tunerline.llm.common import lean, worker_state

#: What an unknown character costs below the least score, as unigram tokenizers have it.
UNK_PENALTY = 10.0
CACHE = 400_000
CACHED_CHARS = 64


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a sentencepiece model with their scores; control, unknown and byte pieces are no matches."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter(dict):
    """Word -> (pieces, score), filled as asked for."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.unk = min((s for _, s in pieces), default=0.0) - UNK_PENALTY

    def viterbi(self, word: str) -> tuple[int, float]:
        """Best score and its number of pieces. At equal scores the path whose last piece starts earlier stays: matches
        that end at one place come longest first, and only a greater score replaces one. A character without a piece of
        its own may also be unknown; it then counts as its UTF-8 bytes, as with byte fallback."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for at, (length, score) in self.automaton.iter(word):
                ends[at + 1].append((length, score))
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            top, pieces, single = None, 0, False
            for length, score in ends[e]:
                s = e - length
                if length == 1:
                    single = True
                x = best[s] + score
                if top is None or x > top:
                    top, pieces = x, count[s] + 1
            if not single:
                x = best[e - 1] + self.unk
                if top is None or x > top:
                    top, pieces = x, count[e - 1] + len(word[e - 1].encode("utf-8", "surrogatepass"))
            best[e], count[e] = top, pieces
        return count[n], best[n]

    def __missing__(self, word: str) -> tuple[int, float]:
        made = self.viterbi("▁" + word)
        if len(word) <= CACHED_CHARS:
            self[word] = made
        return made


def words(text: str) -> list[str]:
    """The stretches between word marks, blanks taken as marks, each of which the tokenizer segments alone, with a mark put before."""
    text = text.replace(" ", "▁")
    if not text:
        return []
    return (text[1:] if text[0] == "▁" else text).split("▁")


def count(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens long, score double, n_chars long.

    n_tokens is the number of pieces of the best unigram segmentation of the whole text, score that segmentation's sum.
    Null and empty texts have 0 tokens and score 0. Equal ids and repeated rows each give their row. Nothing is
    shuffled; only the vocabulary, whose size the model fixes, is broadcast. Other columns of docs are not read.
    """
    lean(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(pieces), f"unigram:{uuid.uuid4().hex}"
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        seen = worker_state(key, lambda: Counter(shared.value))
        for b in batches:
            n, scores, chars = [], [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                found = [seen[w] for w in words(text)]
                n.append(sum([x[0] for x in found]))
                scores.append(float(sum([x[1] for x in found])))
                chars.append(len(text))
                if len(seen) > CACHE:
                    seen.clear()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "score": pa.array(scores, pa.float64()), "n_chars": pa.array(chars, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double, n_chars long")
