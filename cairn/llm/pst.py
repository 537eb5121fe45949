"""Scores of texts by a probabilistic suffix tree over words.

Tokens are words in lower case (A-Z alone) and one end a text. Every run of up to DEPTH tokens
that the training texts hold MIN_COUNT times or more is a context that may become a
state of the tree. It does if its followers diverge from those of its longest proper
suffix (at depth 1: from the words as such): the sum over followers w of
``c(s,w) * ln(HALF * (c(s,w) - 1) / ((c(s) - 1) * p(w)) + 1 - HALF)``, where p(w) is the suffix's share of w,
must reach MIN_GAIN. As each follower is left out of its own count, followers that
came once speak against a state, and contexts that only look different by chance go. A token is
scored by the longest kept state that ends before it, whose counts are smoothed with
the next shorter kept one: ``(c(s,w) + T(s) * p(w)) / (c(s) + T(s))``, T being the number of
distinct followers, down to the words, ``(c(w) + 0.1) / (N + 0.1 * (V + 1))``. So
for every history the probabilities of all known tokens and one unknown sum to 1.

The table becomes chunks of numbered tokens. Runs of tokens are counted a length at a
time: each chunk sends its distinct ones with their counts to hash buckets, which answer with the totals and a
number for each frequent one, so that the next longer run is a pair of numbers, exactly. One of the chunks
that hold a run adds it to its context's gain; contexts are summed the same way. Whatever
a word's or context's share of the corpus is, it is one entry for each chunk. Nothing of
the model comes to the driver but N and V.

Cases: null text is empty and has the end alone; a null id counts as empty, which is
held out; rows that share an id are texts each; texts are scored whole, long ones in a
chunk of their own; without training texts all known probabilities are those of unseen
words; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import _chunks as C
from cairn.llm import _vector as V
from cairn.llm._spark import settle
from cairn.sources.shared import forget

DEPTH, MIN_COUNT, MIN_GAIN, HALF = 2, 8, 2.0, 0.5
#: Texts whose checksum has this remainder are held out.
FOLDS, HELD = 10, 0
ADDED = 0.1
#: Slices of the table in one chunk, and compressed bytes of the table that a bucket stands for.
JOIN, BUCKET_BYTES = 8, 8 << 20
#: Gains are summed as whole numbers of this size, so that their order does not matter.
GRAIN = 1 << 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays of whole numbers in as few bytes as they need: those that ascend as differences, all of them byte plane by byte plane."""
    names, bodies = [], []
    for name, a in arrays.items():
        kind = ""
        if len(a) and a.dtype.kind == "i" and a.min() < 0:
            a, kind = (a << 1) ^ (a >> 63), "z"  # the sign goes last
        a = _small(a)
        if a.dtype.itemsize > 1 and not (a[1:] >= a[:-1]).all():  # those that ascend are taken apart below
            kind += f"p{a.dtype.itemsize}"
            a = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).ravel()
        names.append(f"{name}:{kind}")
        bodies.append(a)
    return C.pack(np.frombuffer(",".join(names).encode(), np.uint8), *bodies)


def unpack(body: bytes) -> dict[str, np.ndarray]:
    names, *arrays = C.unpack(body)
    out = {}
    for named, a in zip(names.tobytes().decode().split(","), arrays, strict=True):
        name, kind = named.split(":")
        if "p" in kind:
            size = int(kind[-1])
            a = np.ascontiguousarray(a.reshape(size, -1).T).view(f"<u{size}")[:, 0]
        if kind.startswith("z"):
            a = a.astype(np.int64)
            a = (a >> 1) ^ -(a & 1)
        out[name] = a
    return out


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the number of each key; by hashing, and sorting the distinct ones alone."""
    coded = pa.array(keys).dictionary_encode()
    codes, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], first[order], place[codes]


def held_out(id_: int | None) -> bool:
    return zlib.crc32(b"" if id_ is None else str(id_).encode()) % FOLDS == HELD


def tokens(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many tokens each text has, the number of each token, and the numbered words; the end is the empty word."""
    data = _LOWER[chunk.data]
    starts, ends, first = V.words(data, chunk.offsets)
    number, words = V.numbered_words(data, starts, ends)
    sizes = np.diff(first) + 1
    out = np.full(int(sizes.sum()), len(words), np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = number
    return sizes, out, pa.concat_arrays([words, pa.array([b""], words.type)])


class Grams:
    """The runs of tokens of a chunk, by length from 1: ``at[k]`` the number of the run of k that ends at each token, or -1; ``items[k]`` the (context, word) of each, ``rep[k]`` a place of each."""

    def __init__(self, state: dict[str, np.ndarray], longest: int):
        self.state = state
        tok = state["tok"].astype(np.int32)
        self.width = len(state["c1"])
        self.fresh = np.cumsum(state["sizes"].astype(np.int64)) - state["sizes"]
        self.at, self.items, self.rep = {1: tok}, {}, {}
        for k in range(2, longest + 1):
            self.grow(k)

    def count(self, k: int) -> np.ndarray:
        return self.state[f"c{k}"].astype(np.int64)

    def grow(self, k: int) -> None:
        """Finds the runs of k, once those of k - 1 have their counts and numbers."""
        before = np.full(len(self.at[1]), -1, np.int32)
        before[1:] = self.at[k - 1][:-1]
        before[self.fresh] = -1
        frequent = np.flatnonzero(self.count(k - 1) >= MIN_COUNT)  # contexts, in the order of their numbers
        frequent = frequent[np.argsort(self.state[f"id{k - 1}"][frequent])]
        rank = np.full(len(self.state[f"c{k - 1}"]) + 1, -1, np.int32)
        rank[frequent] = np.arange(len(frequent))
        before = rank[before]  # the last is that of no run
        good = np.flatnonzero(before >= 0)
        keys, rep, number = _distinct(before[good].astype(np.int64) * self.width + self.at[1][good])
        self.at[k] = np.full(len(before), -1, np.int32)
        self.at[k][good] = number
        context, word = np.divmod(keys, max(self.width, 1))
        self.items[k], self.rep[k] = (frequent[context], word), good[rep]

    def trained(self) -> np.ndarray:
        """Which tokens are of training texts."""
        return np.repeat(self.state["held"] == 0, self.state["sizes"].astype(np.int64))

    def counts(self, k: int) -> np.ndarray:
        """How often the chunk's training texts hold each run."""
        at = self.at[k][self.trained()]
        return np.bincount(at[at >= 0], minlength=len(self.items[k][0]))

    def order(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of k in the order of buckets, and of the numbers of contexts and words in each; with these numbers and the buckets."""
        context, word = self.items[k]
        ids, words = self.state[f"id{k - 1}"].astype(np.uint64)[context], self.state["id1"].astype(np.uint64)[word]
        where = bucket_of(V.mix(ids) + words * np.uint64(V._P1), bits)
        return np.argsort(where, kind="stable"), ids, where

    def contexts(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of k that are contexts of runs here, in the order of buckets and numbers; with these numbers and the buckets."""
        seen = np.zeros(len(self.state[f"c{k}"]), bool)
        seen[self.items[k + 1][0]] = True
        here = np.flatnonzero(seen)
        ids = self.state[f"id{k}"].astype(np.uint64)[here]
        where = bucket_of(ids * np.uint64(V._P2), bits)
        order = np.lexsort((ids, where))
        return here[order], ids[order], where[order]

    def share(self, k: int, total: int) -> np.ndarray:
        """For each run of k + 1, the share of its last word after the run before it without the first token."""
        word, rep = self.items[k + 1][1], self.rep[k + 1]
        if k == 1:
            return self.count(1)[word] / max(total, 1)
        return self.count(k)[self.at[k][rep]] / self.count(k - 1)[self.at[k - 1][rep - 1]]


def bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    kind = np.uint16 if bits <= 16 else np.uint32  # short numbers are sorted by their digits
    return (V.mix(key) >> np.uint64(64 - bits)).astype(kind) if bits else np.zeros(len(key), kind)


def gains(c: np.ndarray, of: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What each follower (c times of ``of``) says for its context against the share, in GRAIN parts; followers that were not seen say nothing."""
    seen = np.maximum(c, 1)
    gain = seen * np.log(HALF * (seen - 1) / (np.maximum(of - 1, 1) * np.where(c > 0, share, 1)) + 1 - HALF)
    return np.where(c > 0, np.rint(gain * GRAIN), 0).astype(np.int64)


def _parts(where: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of sorted ones, and where it is."""
    begin = np.flatnonzero(np.diff(where.astype(np.int64), prepend=-1)).tolist()
    for a, b in zip(begin, [*begin[1:], len(where)][: len(begin)], strict=True):
        yield int(where[a]), slice(a, b)


def _send_words(state: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    words, where = _words(state), state["where"].astype(np.int64)
    offsets = state["ends"].astype(np.int64)
    tok = state["tok"][np.repeat(state["held"] == 0, state["sizes"].astype(np.int64))]
    counts = np.bincount(tok, minlength=len(words))
    for b, part in _parts(where):
        a, e = offsets[part.start - 1] if part.start else 0, offsets[part.stop - 1]
        yield b, pack(bucket=np.array([b]), ends=offsets[part] - a, text=state["text"][a:e], n=counts[part])


def _words(state: dict[str, np.ndarray]) -> pa.Array:
    ends = state["ends"].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(state["text"]))])


def _send_runs(k: int, depth: int, total: int, bits: int, grams: Grams) -> Iterator[tuple[int, bytes]]:
    """Runs of k tokens, if k is at most depth + 1, and what the chunk's own runs of k - 1 say of their contexts."""
    state = grams.state
    out: dict[int, dict[str, np.ndarray]] = {}
    if k <= depth + 1:
        grams.grow(k)
        order, ids, where = grams.order(k, bits)
        words, counts = state["id1"].astype(np.uint64)[grams.items[k][1]], grams.counts(k)
        for b, part in _parts(where[order]):
            at = order[part]
            out.setdefault(b, {}).update(id=ids[at], word=words[at], n=counts[at])
    if k >= 3:
        here, ids, where = grams.contexts(k - 2, bits)
        context = grams.items[k - 1][0]
        c = np.where(state["own"] > 0, grams.count(k - 1), 0)
        gain = gains(c, grams.count(k - 2)[context], grams.share(k - 2, total))
        width = len(state[f"c{k - 2}"])
        kinds = np.bincount(context[c > 0], minlength=width)
        sums = np.zeros(width, np.int64)
        np.add.at(sums, context, gain)
        for b, part in _parts(where):
            out.setdefault(b, {}).update(context=ids[part], kinds=kinds[here[part]], gain=sums[here[part]])
    for b, arrays in out.items():
        yield b, pack(bucket=np.array([b]), **arrays)


def _judge(count: int) -> Callable[[list[bytes]], list[bytes | None]]:
    def judge(bodies: list[bytes]) -> list[bytes | None]:
        parts = [unpack(b) for b in bodies]
        bucket = int(parts[0]["bucket"][0])
        answers: list[dict[str, np.ndarray]] = [{} for _ in parts]
        counted = [i for i, p in enumerate(parts) if "n" in p]
        if counted:
            n = np.concatenate([parts[i]["n"].astype(np.int64) for i in counted])
            if "text" in parts[counted[0]]:
                key = pa.concat_arrays([_words(parts[i]) for i in counted]).dictionary_encode().indices.to_numpy()
                order = np.argsort(key, kind="stable")
                new = key[order][1:] != key[order][:-1]
            else:
                id_, word = (np.concatenate([parts[i][c].astype(np.uint64) for i in counted]) for c in ("id", "word"))
                order = np.lexsort((word, id_))
                id_, word = id_[order], word[order]
                new = (id_[1:] != id_[:-1]) | (word[1:] != word[:-1])
            begin = np.flatnonzero(np.concatenate([[True], new]))
            group = np.empty(len(n), np.int64)
            group[order] = np.cumsum(np.concatenate([[0], new]))
            totals = np.add.reduceat(n[order], begin)
            own = np.zeros(len(n), np.uint8)
            own[order[begin]] = 1
            text = "text" in parts[counted[0]]
            number = (np.cumsum(text | (totals >= MIN_COUNT)) - 1) * count + bucket
            at = 0
            for i in counted:
                g = group[at : at + len(parts[i]["n"])]
                mine = own[at : at + len(g)]
                at += len(g)
                answers[i] |= {"c": totals[g], "own": np.packbits(mine), "id": number[g] if text else number[g][totals[g] >= MIN_COUNT]}
        told = [i for i, p in enumerate(parts) if "context" in p]
        if told:
            context, kinds, gain = (np.concatenate([parts[i][c].astype(np.int64) for i in told]) for c in ("context", "kinds", "gain"))
            known, group = np.unique(context, return_inverse=True)
            sums = np.zeros((2, len(known)), np.int64)
            np.add.at(sums[0], group, kinds)
            np.add.at(sums[1], group, gain)
            kept = np.where(sums[1] >= MIN_GAIN * GRAIN, sums[0], 0)
            at = 0
            for i in told:
                size = len(parts[i]["context"])
                answers[i]["t"] = kept[group[at : at + size]]
                at += size
        return [pack(**a) for a in answers]

    return judge


def _merged(said: dict[int, dict[str, np.ndarray]], where: list[tuple[int, slice]], out: np.ndarray, how: Callable) -> np.ndarray:
    """One array out of the answers of all buckets, in the order that was sent."""
    for b, part in where:
        out[part] = how(said[b], part.stop - part.start)
    return out


def _plain(name: str) -> Callable:
    return lambda a, size: a[name]


def _bits(a: dict[str, np.ndarray], size: int) -> np.ndarray:
    return np.unpackbits(a["own"], count=size)


def _take_words(state: dict[str, np.ndarray], said: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The state with the words' numbers and counts; tokens are numbered anew, frequent words first, which makes them small."""
    where = list(_parts(state["where"].astype(np.int64)))
    ids, c = (_merged(said, where, np.zeros(len(state["where"]), np.int64), _plain(name)) for name in ("id", "c"))
    order = np.lexsort((ids, -np.bincount(state["tok"], minlength=len(ids))))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return {"sizes": state["sizes"], "held": state["held"], "tok": place[state["tok"]], "id1": ids[order], "c1": c[order]}


def _take_runs(k: int, depth: int, bits: int, state: dict[str, np.ndarray], said: dict[int, dict[str, np.ndarray]]) -> Grams:
    """The runs with what the buckets say of those of k and of the contexts of k - 2."""
    grams = Grams(state, min(k, depth + 1))
    more: dict[str, np.ndarray] = {}
    if k <= depth + 1:
        order, _, where = grams.order(k, bits)
        parts = list(_parts(where[order]))
        n = len(order)
        c, own, ids = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.int64)

        def numbers(a: dict[str, np.ndarray], size: int) -> np.ndarray:
            full = np.zeros(size, np.int64)
            full[a["c"] >= MIN_COUNT] = a["id"]
            return full

        for out, how in ((c, _plain("c")), (own, _bits), (ids, numbers)):
            out[order] = _merged(said, parts, np.zeros(n, out.dtype), how)
        more |= {f"c{k}": c, "own": own} | ({f"id{k}": ids} if k <= depth else {})
    if k >= 3:
        here, _, where = grams.contexts(k - 2, bits)
        kinds = np.zeros(len(state[f"c{k - 2}"]), np.int64)
        kinds[here] = _merged(said, list(_parts(where)), np.zeros(len(here), np.int64), _plain("t"))
        more[f"t{k - 2}"] = kinds
    grams.state = {n: a for n, a in state.items() if n != "own"} | more
    return grams


def _first(chunk: C.Chunk, raw_ids: list, bits: int) -> dict[str, np.ndarray]:
    """The state of a new chunk: texts' sizes, which are held out, tokens, and the words in the order of their buckets."""
    sizes, tok, words = tokens(chunk)
    text, ends = V.buffers(words)
    where = bucket_of(V.spans_hash(V.prefix(V._BYTE[V._P1][text], V._P1), ends[:-1], ends[1:], V._P1), bits)  # their bytes tell them apart there
    order = np.argsort(where, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = words.take(pa.array(order))
    text, offsets = V.buffers(words)
    return {"sizes": sizes, "held": np.array([held_out(i) for i in raw_ids], np.uint8), "tok": place[tok], "where": where[order], "ends": offsets[1:], "text": text}


#: Rows of states have bucket -1 and ids, messages the bucket.
_BOTH = ["chunk", "ids", "bucket", "body"]


def _rows(chunk: int, ids: pa.Array, state: dict[str, np.ndarray], messages: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    """The state of a chunk and its messages."""
    sent = list(messages)
    own = pa.concat_arrays([ids, pa.nulls(len(sent), ids.type)])
    return pa.RecordBatch.from_arrays([pa.array([chunk] * (1 + len(sent)), pa.int64()), own, pa.array([-1, *(b for b, _ in sent)], pa.int32()), pa.array([pack(**state), *(m for _, m in sent)], pa.binary())], _BOTH)


def _answered(both: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """States (chunk, ids, body, answers) with the buckets' answers to their messages, and the settled answers."""
    answers = settle(C.answer(both.filter("bucket >= 0").select("bucket", "chunk", "body"), count, _judge(count)), free=True)
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias("answers"))
    states = both.filter("bucket < 0").select("chunk", "ids", "body")
    return states.join(grouped.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "body", "answers"), answers


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, dict[str, np.ndarray], dict[int, dict[str, np.ndarray]]]]:
    """chunk, ids, state and answers by bucket of each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            said = {a["bucket"]: unpack(a["body"]) for a in batch.column(3)[i].as_py() or []}
            yield batch.column(0)[i].as_py(), batch.column(1).slice(i, 1), unpack(batch.column(2)[i].as_py()), said


def _totals(both: DataFrame, answers: DataFrame) -> tuple[int, int]:
    """How many training tokens the states hold, and how many distinct ones the words' answers."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = (unpack(body) for body in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([int(s["sizes"][s["held"] == 0].sum()) for s in states], pa.int64())], ["n"])

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = (unpack(body) for body in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([int(_bits(a, len(a["c"]))[a["c"] > 0].sum()) for a in said], pa.int64())], ["n"])

    parts = both.filter("bucket < 0").select("body").mapInArrow(trained, "n long"), answers.select("body").mapInArrow(fresh, "n long")
    return tuple(p.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0] for p in parts)  # type: ignore[return-value]


def scores(grams: Grams, depth: int, n: int, v: int) -> dict[str, np.ndarray]:
    """Of each text: held_out, n_tokens, n_known, base_score and score."""
    state = grams.state
    sizes = state["sizes"].astype(np.int64)
    c = grams.count(1)[grams.at[1]]
    p = (c + ADDED) / (n + ADDED * (v + 1))
    begin = np.cumsum(sizes) - sizes
    each = lambda x: np.add.reduceat(x, begin) if len(sizes) else np.zeros(0)
    base = each(np.log10(p))
    for d in range(1, depth + 1):
        here = np.flatnonzero(grams.at[d + 1] >= 0)
        context = grams.at[d][here - 1]
        kinds = state[f"t{d}"].astype(np.int64)[context]
        kept = kinds > 0
        here, context, kinds = here[kept], context[kept], kinds[kept]
        p[here] = (grams.count(d + 1)[grams.at[d + 1][here]] + kinds * p[here]) / (grams.count(d)[context] + kinds)
    return {"held_out": state["held"] > 0, "n_tokens": sizes, "n_known": each((c > 0).astype(np.int64)).astype(np.int64), "train_tokens": np.full(len(sizes), n), "base_score": base, "score": each(np.log10(p))}


def apply(df: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability) of every text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = C.make(rows, "text", JOIN)
    count = C.buckets_for(chunks, BUCKET_BYTES)
    bits = count.bit_length() - 1
    id_type = rows.schema["id"].dataType
    kinds = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("bucket", T.IntegerType()), T.StructField("body", T.BinaryType())])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = C._open(body, "id", "text")
                ids = chunk.batch.column(0)
                state = _first(chunk, ids.to_pylist(), bits)
                kept = {name: state[name] for name in ("sizes", "held", "tok", "where")}  # the words themselves go to the buckets alone
                yield _rows(number, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), kept, _send_words(state))

    both = settle(chunks.mapInArrow(begin, kinds))
    forget(chunks)
    states, answers = _answered(both, count)
    n, v = _totals(both, answers)
    for k in range(2, depth + 3):

        def step(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for chunk, ids, state, said in _each(batches):
                grams = Grams(_take_words(state, said), 1) if k == 2 else _take_runs(k - 1, depth, bits, state, said)
                sent = list(_send_runs(k, depth, n, bits, grams))
                yield _rows(chunk, ids, grams.state, iter(sent))

        after = settle(states.mapInArrow(step, kinds), free=True)
        forget(answers)
        forget(both)
        both = after
        states, answers = _answered(both, count)
    fields = T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields
    schema = T.StructType([T.StructField(id_col, id_type), *fields])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, state, said in _each(batches):
            found = scores(_take_runs(depth + 2, depth, bits, state, said), depth, n, v)
            yield pa.RecordBatch.from_arrays([ids[0].values, *(pa.array(a) for a in found.values())], schema.names)

    return states.mapInArrow(end, schema)
