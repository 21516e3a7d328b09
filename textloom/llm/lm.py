"""Language-model scoring by a weighted backoff automaton.

The model is a trigram model with Dirichlet priors: p(w | h) = (c(hw) + PRIOR * p(w | h')) / (c(h) + PRIOR), where h'
is the history h without its first word; under bigrams lie add-one unigrams with one place for all unknown words, so
probabilities of all continuations sum to one. As an automaton: the root, every known word, the start of a text and
every bigram that is known LEAST_STATE times or oftener are states; every known n-gram whose history is a state is an
arc with its log probability, to the state of the longest history that it leaves. Each state has a failure arc to
that of its history's end, with the weight log10(PRIOR / (c(h) + PRIOR)): from a bigram to its last word, from there to
the root, where each word has an arc of its unigram log probability. A text is scored in one left-to-right traversal.

The counts of a whole corpus fit no single task, so each block of documents is scored by the part of the automaton
that its own words can reach. A block sends each distinct word and bigram once, with its count in the block's training
texts; buckets of hash ranges add the counts up and answer each block with what the others have. Then trigrams go
the same way, but for those that can't stand in another block, as one of their bigrams doesn't.
"""

from __future__ import annotations

import gc
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordblocks import contents, hashes, mix, parts_for, runs_of, split_words, stored_blocks

#: Weight of the unigrams under a word's bigrams, and of the bigrams under a bigram's trigrams, in counts.
PRIOR, TRIGRAM_PRIOR = 60.0, 4.0
#: A bigram is a state if it stands so often in the training texts.
LEAST_STATE = 2
#: Hashes of the start and the end of a text.
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of keys.
WORD, BIGRAM, TRIGRAM = 1, 2, 3
#: The widest gap between packed keys, in bytes; wider ones are bridged by keys that stand for nothing.
GAP_BYTES = 6


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    narrow = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return bytes([width]) + zstandard.compress(narrow, 1)


def unpack(packed: bytes) -> np.ndarray:
    narrow = np.frombuffer(zstandard.decompress(packed[1:]), np.uint8).reshape(-1, packed[0])
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, : packed[0]] = narrow
    return wide.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as gaps of GAP_BYTES each. A gap of 0 bridges as many as the gap after it counts."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = gaps >> np.uint64(8 * GAP_BYTES)
    if len(keys) and int(keys[0]) == 0:
        raise ValueError("a key of 0")
    at = np.flatnonzero(wide)
    # Each wide gap becomes 0, its upper part, its lower part.
    gaps = np.insert(gaps & np.uint64((1 << 8 * GAP_BYTES) - 1), np.repeat(at, 2), np.stack([np.zeros(len(at), np.uint64), wide[at]], 1).reshape(-1))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GAP_BYTES].tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    narrow = np.frombuffer(packed, np.uint8).reshape(-1, GAP_BYTES)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :GAP_BYTES] = narrow
    gaps = wide.reshape(-1).view("<u8").copy()
    marks = np.flatnonzero(gaps == 0)
    # A lower part can be 0 too; a mark is never within two places of the one before.
    real, last = [], -3
    for k in marks.tolist():
        if k > last + 2:
            real.append(k)
            last = k
    at = np.array(real, np.int64)
    gaps[at + 2] += gaps[at + 1] << np.uint64(8 * GAP_BYTES)
    return np.cumsum(np.delete(gaps, np.concatenate([at, at + 1])), dtype=np.uint64)


def in_range_buckets(keys: np.ndarray, parts: int) -> np.ndarray:
    """The number in 0..parts-1 of the range that each key falls in; ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key, never 0, for what stands before (by its hash or key) and a word's hash."""
    return mix(before * GOLD + mix(word)) | np.uint64(1)


class Block:
    """The tokens of a block's texts, by number of distinct word, bigram and trigram."""

    def __init__(self, words: np.ndarray, word: np.ndarray, lengths: np.ndarray):
        """words: the ascending hashes of the distinct words; word: each token's word; lengths: tokens of each text."""
        self.words, self.word, self.lengths = words, word.astype(np.int64), lengths
        self.firsts = np.cumsum(lengths) - lengths
        tokens = words[self.word]
        before = np.append(START, tokens[:-1])
        before[self.firsts] = START
        self.keys = bigram_keys(before, tokens)
        self.bigrams, self.first, self.bigram = np.unique(self.keys, return_index=True, return_inverse=True)
        #: Number of the word before each token; -1 at the start of a text.
        self.before = np.append(-1, self.word[:-1])
        self.before[self.firsts] = -1
        #: Number of the bigram that ends before each token; -1 at the start of a text.
        self.history = np.append(-1, self.bigram[:-1])
        self.history[self.firsts] = -1

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Block:
        return cls(*words_of(texts))

    def find_trigrams(self, where: np.ndarray) -> None:
        """Numbers the trigrams that end at the tokens `where`: trigrams, first_trigram (a token), and trigram, which
        is -1 for other tokens."""
        at = np.flatnonzero(where & (self.history >= 0))
        keys = bigram_keys(self.bigrams[self.history[at]], self.words[self.word[at]])
        self.trigrams, first, number = np.unique(keys, return_index=True, return_inverse=True)
        self.first_trigram = at[first]
        self.trigram = np.full(len(self.word), -1)
        self.trigram[at] = number

    def counts(self, learn: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        """How often each of n keys, numbered for each token, stands in the texts to learn from."""
        return np.bincount(numbers[np.repeat(learn, self.lengths) & (numbers >= 0)], minlength=n).astype(np.uint64)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' hashes, each token's word, and tokens of each text."""
    words = [hashes(split_words(t, lower=True)) for t in texts]
    end = np.array([END])
    distinct, word = np.unique(np.concatenate([x for w in words for x in (w, end)]), return_inverse=True)
    return distinct, word, np.fromiter((len(w) + 1 for w in words), np.int64, len(words))


class BackoffAutomaton:
    """State 0 is the root, state 1 the start of a text, then come words, then bigrams. Arcs of all states but the
    root are in one table keyed by state and word; what they lack goes by the failure arc."""

    def __init__(self, block: Block, words, bigrams, trigrams, total: int, distinct: int, priors=(PRIOR, TRIGRAM_PRIOR), least=LEAST_STATE):
        """words, bigrams, trigrams: the whole corpus's count of each of the block's keys."""
        c, n = words.astype(np.float64), len(words)
        known = words > 0
        # The start of a text stands as often as its end.
        held = np.concatenate([[np.inf, c[int(np.searchsorted(block.words, END))]], c, bigrams.astype(np.float64)])
        place = block.first
        word, before = block.word[place], block.before[place]
        word_state = np.where(known, np.arange(n) + 2, 0)
        bigram_state = np.where(bigrams >= least, np.arange(len(bigrams)) + 2 + n, word_state[word])
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = np.log10(np.repeat(priors, [2 + n, len(bigrams)]) / (held + np.repeat(priors, [2 + n, len(bigrams)])))
        weights[0] = 0.0
        self.fail_weight = weights.tolist()
        self.fail_state = np.concatenate([np.zeros(2 + n, np.int64), word_state[word]]).tolist()
        p = (c + 1) / (total + distinct + 1)
        self.root_weight, self.root_next = np.log10(p).tolist(), word_state.tolist()
        self.size = n
        state = np.where(before < 0, 1, word_state[before])
        # The start counts as a history of each text's first word.
        p2 = (bigrams + priors[0] * p[word]) / (held[state] + priors[0])
        seen = np.flatnonzero(bigrams > 0)
        keys, values, onward = (state * n + word)[seen].tolist(), np.log10(p2[seen]).tolist(), bigram_state[seen].tolist()
        self.arcs = dict(zip(keys, zip(values, onward, strict=True), strict=True))
        at = block.first_trigram
        history, last, word = block.history[at], block.bigram[at], block.word[at]
        seen = np.flatnonzero((trigrams > 0) & (bigrams[history] >= least))
        history, last, word = history[seen], last[seen], word[seen]
        p3 = (trigrams[seen] + priors[1] * p2[last]) / (bigrams[history] + priors[1])
        keys, values, onward = ((history + 2 + n) * n + word).tolist(), np.log10(p3).tolist(), bigram_state[last].tolist()
        self.arcs.update(zip(keys, zip(values, onward, strict=True), strict=True))
        self.start = 1

    def score(self, words: list[int]) -> float:
        """The log10 probability of a text, given as word numbers with its end."""
        state, total, arcs, size = self.start, 0.0, self.arcs, self.size
        fail, back, weights, onward = self.fail_weight, self.fail_state, self.root_weight, self.root_next
        for word in words:
            while state:
                if arc := arcs.get(state * size + word):
                    total += arc[0]
                    state = arc[1]
                    break
                total += fail[state]
                state = back[state]
            else:
                total += weights[word]
                state = onward[word]
        return total


def pack_block(rows: list[tuple]) -> bytes:
    """A block's rows (doc_id, text, held_out): ids and tokens."""
    words, word, lengths = words_of([text for _, text, _ in rows])
    out = io.BytesIO()
    np.savez(
        out,
        doc_id=np.array([r[0] or 0 for r in rows], np.int64),
        no_id=np.array([r[0] is None for r in rows]),
        held=np.array([r[2] for r in rows]),
        lengths=lengths,
        word=word.astype(np.uint32),
        words=np.frombuffer(pack_keys(words), np.uint8),
    )
    return zstandard.compress(out.getbuffer(), 3)


def unpack_block(data: bytes) -> tuple[dict[str, np.ndarray], Block]:
    with np.load(io.BytesIO(zstandard.decompress(data))) as file:
        found = {name: file[name] for name in file.files}
    return found, Block(unpack_keys(found["words"].tobytes()), found["word"], found["lengths"])


COUNTS = "block long, bucket int, kind int, keys binary, counts binary"
ANSWERS = "block long, bucket int, kind int, others binary, total long, distinct_keys long"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def scored(docs: DataFrame, held_out, priors: tuple[float, float] = (PRIOR, TRIGRAM_PRIOR), least: int = LEAST_STATE) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out is a condition on docs; where it is true or null (as for a null doc_id) a row is scored, but not
    learned from. Null and empty texts have their end as their only token. Repeated rows count each time. If
    there is nothing to learn from, all words are unknown. Other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    blocks, folder = stored_blocks(rows, "tokens", pack_block)
    tasks, buckets = parts_for(blocks)
    listed = blocks.repartition(tasks, "block")
    sent_schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def sent(block: int, kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        found = [(b, pack_keys(keys[at]), pack(counts[at])) for b, at in runs_of(in_range_buckets(keys, buckets))]
        numbers, packed, counted = zip(*found, strict=True) if found else ((), (), ())
        n = len(found)
        columns = ([block] * n, numbers, [kind] * n, packed, counted)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, sent_schema.types, strict=True)], schema=sent_schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in contents(batch, folder):
                found, block = unpack_block(data)
                learn = ~found["held"]
                yield sent(number, WORD, block.words, block.counts(learn, block.word, len(block.words)))
                yield sent(number, BIGRAM, block.bigrams, block.counts(learn, block.bigram, len(block.bigrams)))

    def answer(table: pa.Table) -> pa.Table:
        """For each block's keys twice the other blocks' count, and 1 more if another block has the key at all."""
        keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x) for x in table.column("counts").to_pylist()])
        _, where, blocks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        totals = np.bincount(where, counts, len(blocks)).astype(np.uint64)
        others = 2 * (totals[where] - counts) + (blocks[where] > 1)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        last = [0] * (table.num_rows - 1)
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "kind": table.column("kind"),
                "others": pa.array([pack(x) for x in np.split(others, cuts)], pa.binary()),
                "total": pa.array([int(totals.sum()), *last], pa.int64()),
                "distinct_keys": pa.array([int((totals > 0).sum()), *last], pa.int64()),
            }
        )

    def answered(block: Block, found: dict, answers: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By kind: each key's count in the whole corpus, and whether other blocks have it."""
        answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds, others = np.array(answers.column("kind"), np.int64), answers.column("others").to_pylist()
        out = {}
        for kind, at in runs_of(kinds):
            values = np.concatenate([unpack(x) for x in others[at]])
            numbers, n = {WORD: (block.word, len(block.words)), BIGRAM: (block.bigram, len(block.bigrams))}.get(kind) or (
                block.trigram, len(block.trigrams)
            )
            own = block.counts(~found["held"], numbers, n)
            if kind == TRIGRAM:  # those that went
                shared = block.shared_trigrams
                own[shared] += values >> np.uint64(1)
                out[kind] = own, shared
            else:
                out[kind] = own + (values >> np.uint64(1)), (values & np.uint64(1)) > 0
        return out

    def with_trigrams(block: Block, counts: dict) -> None:
        """Numbers the trigrams whose history is a state; shared_trigrams are those that other blocks may have."""
        bigrams, shared = counts[BIGRAM]
        block.find_trigrams((bigrams >= least)[block.history])
        at = block.first_trigram
        block.shared_trigrams = shared[block.history[at]] & shared[block.bigram[at]]

    def send_trigrams(table: pa.Table, answers: pa.Table) -> pa.Table:
        ((number, data),) = contents(table, folder)
        found, block = unpack_block(data)
        with_trigrams(block, answered(block, found, answers))
        own = block.counts(~found["held"], block.trigram, len(block.trigrams))
        return pa.Table.from_batches([sent(number, TRIGRAM, block.trigrams[block.shared_trigrams], own[block.shared_trigrams])])

    def exchanged(keys: DataFrame, label: str) -> DataFrame:
        dealt = keys.repartition(buckets, "kind", "bucket").groupBy("kind", "bucket")
        return written(dealt.applyInArrow(answer, ANSWERS), label)

    def replies(answers: DataFrame) -> DataFrame:
        return answers.select("block", "bucket", "kind", "others").repartition(tasks, "block")

    counts = exchanged(listed.mapInArrow(send, COUNTS), "counts")
    words = counts.where(F.col("kind") == WORD).agg(F.sum("total"), F.sum("distinct_keys")).first()
    total, distinct = (x or 0 for x in words)
    trigrams = listed.groupBy("block").cogroup(replies(counts).groupBy("block")).applyInArrow(send_trigrams, COUNTS)
    trigrams = exchanged(trigrams, "trigram-counts")

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        ((_, data),) = contents(table, folder)
        gc.disable()  # the automaton has no cycles, and its many arcs are slow to go through
        found, block = unpack_block(data)
        first = np.array(answers.column("kind"), np.int64) != TRIGRAM
        counts = answered(block, found, answers.filter(pa.array(first)))
        with_trigrams(block, counts)
        own = block.counts(~found["held"], block.trigram, len(block.trigrams))
        third = answered(block, found, answers.filter(pa.array(~first))).get(TRIGRAM, (own,))[0]
        words = counts[WORD][0]
        automaton = BackoffAutomaton(block, words, counts[BIGRAM][0], third, total, distinct, priors, least)
        base = np.log10((words.astype(np.float64) + 1) / (total + distinct + 1))[block.word]
        known = np.add.reduceat((words > 0)[block.word].astype(np.int64), block.firsts)
        scores = [automaton.score(x.tolist()) for x in np.split(block.word, block.firsts[1:])]
        del automaton
        gc.enable()
        n = len(block.lengths)
        return pa.table(
            {
                "doc_id": pa.array(found["doc_id"], pa.int64(), mask=found["no_id"]),
                "held_out": pa.array(found["held"], pa.bool_()),
                "n_tokens": pa.array(block.lengths, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([total] * n, pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, block.firsts), pa.float64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    both = replies(counts.unionByName(trigrams))
    return listed.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, SCORES)


def remainder(col: str, divisor: int):
    """crc32 of the column as text, modulo divisor."""
    return F.crc32(F.col(col).cast("string")) % divisor
