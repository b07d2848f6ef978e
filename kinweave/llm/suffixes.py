"""Removal of byte strings that also start earlier, by suffix arrays.

A byte goes if a string of `length` bytes covers it that also starts earlier:
in a document of smaller id, or earlier in the same one. Work is dealt out by
content. Every window of `length` bytes has one anchor, the gram of least hash
in it, so equal windows have equal anchors at equal places. Anchors meet by
gram, and where a gram occurs again, its anchors' slices, the unions of their
windows, are gathered. Slices that are one and the same byte for byte are
settled at once (those of one batch before they are shuffled). Where slices of
one gram differ, the parts right and left of the anchor are sorted by a suffix
array of 8-byte symbols, and windows are equal where both neighbours' common
prefixes reach far enough. Hashes only decide what meets, never what goes.

The suffix array is built by linear grouping: suffixes are grouped by Lyndon
prefix, groups taken from the greatest down, previous-smaller pointers say
which suffixes each group extends, and a last pass emits every group's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, node_id, shown_id, table, text_of

LENGTH, GRAM = 100, 32
#: Anchors that a task settles among themselves before they are shuffled.
BATCH = 400_000
#: Rows that are compared, sent and solved at a time.
COMPARED, SENT, SOLVED = 1 << 14, 1 << 14, 1 << 16
#: Anchors of one gram that meet whole; of more, parts by distance meet.
MEETING = 256
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def suffix_array(text: list[int]) -> list[int]:
    """Start places of the suffixes of text in order; a suffix that begins another comes before it."""
    n = len(text) + 1
    if n == 1:
        return []
    low = min(text) - 1
    s = [*(x - low for x in text), 0]
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, x in enumerate(order):
        if s[x] != s[order[start]]:
            start = i
        place[x], group[x] = i, start
        size[start] += 1
    prev = [-1] * n
    count = [0] * n
    end = n
    while end > 0:
        first = group[order[end - 1]]
        members = order[first:end]
        members.sort()
        touched = []
        for x in members:
            p = x - 1
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[x] = p
            if p >= 0:
                if not count[p]:
                    touched.append(p)
                count[p] += 1
        if touched:
            levels: dict[int, list[int]] = {}
            for p in touched:
                levels.setdefault(count[p], []).append(p)
                count[p] = 0
            for level in sorted(levels, reverse=True):
                own = levels[level]
                moved: dict[int, int] = {}
                for p in own:
                    g = group[p]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    to = g + size[g] - m
                    at, other = place[p], order[to]
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
                for p in own:
                    g = group[p]
                    m = moved[g]
                    if m < size[g]:
                        group[p] = g + size[g] - m
                for g, m in moved.items():
                    if m < size[g]:
                        size[g + size[g] - m] = m
                        size[g] -= m
        end = first
    out: list[int] = [-1] * n
    done = [False] * n
    free = list(range(n))
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return out[1:]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Anchors:
    """Finds the anchors of byte strings; tables of powers grow with the longest seen."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.n = length, gram, 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.inverse = [_powers(pow(b, -1, 1 << 64), self.n) for b in BASES]
            self.power = [_powers(b, self.n) for b in BASES]

    def find(self, text: bytes) -> tuple[np.ndarray, ...] | None:
        """(gram hash, slice hash, anchor place, least and greatest distance of its windows' starts)."""
        n, w = len(text), self.length - self.gram + 1
        if n < self.length:
            return None
        self._grow(n + 1)
        b = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * inv[:n])]) for inv in self.inverse]
        grams = _mixed((sums[0][self.gram :] - sums[0][: -self.gram]) * self.power[0][: n - self.gram + 1])
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least, k = key, 1
        while 2 * k <= w:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        m = len(key) - w + 1
        least = np.minimum(least[:m], least[w - k : w - k + m])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([new[1:], [len(at)]]) - 1
        p = at[new]
        lo, hi = p - last, p - new
        begin, end = new, last + self.length
        slices = np.zeros(len(p), np.uint64)
        for sums_, power, salt in zip(sums, self.power, (np.uint64(0x632BE59BD9B4E019), np.uint64(0x9FB21C651E98DF25)), strict=True):
            slices = _mixed(slices ^ ((sums_[end] - sums_[begin]) * power[begin] + salt * (lo * 256 + hi + 1).astype(np.uint64)))
        return grams[p].view(np.int64), slices.view(np.int64), p, lo, hi


def equal_slices(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of buffer from a[k] and from b[k] are the same, size[k] of them; bounded memory.

    Eight bytes are compared at a time, the last eight up to the very end.
    """
    wide = 8 if len(size) and size.min() >= 8 else 1
    words = np.ndarray((len(buffer) - wide + 1,), f"<u{wide}", buffer.tobytes(), strides=(1,))
    out = np.ones(len(a), bool)
    for at in range(0, len(a), COMPARED):
        k = slice(at, at + COMPARED)
        place = np.minimum(np.arange(0, int(size[k].max()), wide), size[k, None] - wide)
        out[k] = (words[a[k, None] + place] == words[b[k, None] + place]).all(axis=1)
    return out


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, twin, text) -> rows (route, span, doc_id, twin, a, b).

    Before anything is shuffled, equal slices of one batch are settled: those
    of equal hash are compared byte by byte, the first stays as an anchor
    (span = 0; route the gram, a the slice, b its packed place), the spans of the
    others are joined (span = 1; from a to b) and routed by document. So neither
    a periodic text nor a passage that many documents share sends more than an
    anchor a batch.
    """
    names = ["route", "span", "doc_id", "twin", "a", "b"]

    def flush(got: list, texts: list[bytes]) -> pa.RecordBatch:
        g, s, doc, twin, at, base = (np.concatenate(c) for c in zip(*got, strict=True))
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        p, lo, hi = at >> 16, (at >> 8) & 255, at & 255
        order = np.lexsort((at, doc, s))
        new = _runs(s[order])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        alike = (lo[order] == lo[head]) & (hi[order] == hi[head])
        from_, to = base[order] + p[order] - hi[order], base[head] + p[head] - hi[head]
        same = alike & (new | equal_slices(buffer, from_, to, (hi - lo)[order] + length))
        place = (doc[order] == doc[head]) & (at[order] == at[head])
        # equal hash but other bytes, or the same place of another text of that id: an anchor of its own
        first = order[new | ~same | (place & (twin[order] != twin[head]))]
        later = order[same & ~place]
        later = later[np.lexsort((at[later], twin[later], doc[later]))]
        d, t = doc[later], twin[later]
        begin, end = p[later] - hi[later], p[later] - lo[later] + length
        opens = _runs(d, t)
        opens[1:] |= begin[1:] > end[:-1]
        k = np.flatnonzero(opens)
        last = np.concatenate([k[1:], [len(later)]]) - 1 if len(k) else k
        spread = _mixed(d[k].astype(np.uint64)).view(np.int64)
        columns = (
            (g[first], spread),
            (np.zeros(len(first), np.int32), np.ones(len(k), np.int32)),
            (doc[first], d[k]),
            (twin[first], t[k]),
            (s[first], begin[k]),
            (at[first], end[last]),
        )
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, gram)
        got, texts, n, size = [], [], 0, 0
        for batch in batches:
            ids, twins = batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist()
            for doc, twin, text in zip(ids, twins, batch.column("text"), strict=True):
                data = text.as_py().encode()
                found = finder.find(data)
                if found is None:
                    continue
                g, s, p, lo, hi = found
                place = (p << 16) | (lo << 8) | hi
                got.append((g, s, np.full(len(g), doc), np.full(len(g), twin), place, np.full(len(g), size)))
                texts.append(data)
                n, size = n + len(g), size + len(data)
                if n >= BATCH:
                    yield flush(got, texts)
                    got, texts, n, size = [], [], 0, 0
        if got:
            yield flush(got, texts)

    return docs.mapInArrow(run, "route long, span int, doc_id long, twin long, a long, b long")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns, which rows begin a new value."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


FOUND = ["open", "doc_id", "twin", "a", "b", "part"]


def _meeting(anchors: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors -> removed spans (open = 0; from a to b), and the anchors whose gram occurs again (open = 1; gram, place).

    The windows of an anchor differ by how far before it they start, and only
    windows of equal distance can be equal. So where a gram has many anchors,
    each is cut into parts by distance, and the parts are compared apart.
    """
    reach = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got) if (got := list(batches)) else None
        if t is None or not t.num_rows:
            return
        ready = t.filter(pc.equal(t.column("span"), 1))
        if ready.num_rows:
            zero = pa.array(np.zeros(ready.num_rows, np.int32))
            columns = [zero, *(ready.column(c) for c in ("doc_id", "twin", "a", "b")), zero]
            yield from pa.table(dict(zip(FOUND, columns, strict=True))).to_batches(max_chunksize=1 << 20)
        t = t.filter(pc.equal(t.column("span"), 0))
        key, doc, twin, at = (t.column(c).to_numpy() for c in ("route", "doc_id", "twin", "b"))
        del t, got, ready
        order = np.argsort(key, kind="stable")
        new = _runs(key[order])
        count = np.diff(np.r_[np.flatnonzero(new), len(order)])
        count = count[np.cumsum(new) - 1]
        own, count = order[count > 1], count[count > 1]
        width = np.maximum(1, reach // -(-count // MEETING))
        first, last = ((at[own] >> 8) & 255) // width, (at[own] & 255) // width
        times = last - first + 1
        for k in range(0, len(own), 1 << 20):
            some = slice(k, k + (1 << 20))
            i = np.repeat(own[some], times[some])
            w = np.repeat(width[some], times[some])
            part = np.arange(len(i)) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
            part += np.repeat(first[some], times[some])
            lo = np.maximum((at[i] >> 8) & 255, part * w)
            hi = np.minimum(at[i] & 255, part * w + w - 1)
            place = (at[i] >> 16 << 16) | (lo << 8) | hi
            columns = [np.ones(len(i), np.int32), doc[i], twin[i], key[i], place, part.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=FOUND)

    schema = "open int, doc_id long, twin long, a long, b long, part int"
    return anchors.repartition("route").mapInArrow(run, schema)


def _slices(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the asked slices: (gram, part, doc_id, twin, at, bytes)."""
    place = F.struct(F.col("a").alias("gram"), F.col("b").alias("at"), "part")
    per_doc = asked.groupBy("doc_id", "twin").agg(F.collect_set(place).alias("asked"))
    wanted = docs.join(per_doc.hint("shuffle_hash"), ["doc_id", "twin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("asked")
            inner = places.flatten()
            gram, at, part = (inner.field(k) for k in range(3))
            size = places.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            where = at.to_numpy()
            begin = ((where >> 16) - (where & 255)).tolist()
            end = ((where >> 16) - ((where >> 8) & 255) + length).tolist()
            texts = [x.as_py().encode() for x in batch.column("text")]
            for k in range(0, len(row), SENT):
                some = slice(k, k + SENT)
                cut_ = [texts[r][a:b] for r, a, b in zip(row[some].tolist(), begin[some], end[some], strict=True)]
                ids = pa.array(row[some])
                columns = [gram[some], part[some], batch.column("doc_id").take(ids), batch.column("twin").take(ids), at[some]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cut_, pa.binary())], names=["gram", "part", "doc_id", "twin", "at", "bytes"]
                )

    schema = "gram long, part int, doc_id long, twin long, at long, bytes binary"
    return wanted.select("doc_id", "twin", "text", "asked").mapInArrow(run, schema).repartition("gram", "part")


def sort_parts(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For byte strings of up to `width` bytes: (rank of each, and for the distinct ones in order: common prefix with the one before, length)."""
    distinct: dict[bytes, int] = {}
    which = np.array([distinct.setdefault(p, len(distinct)) for p in parts], np.int64)
    own = list(distinct)
    size = np.array([len(p) for p in own], np.int64)
    wide = -(-width // 8) * 8
    grid = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in own), np.uint8).reshape(len(own), wide)
    words = np.unique(grid.view(">u8"), return_inverse=True)[1].reshape(len(own), -1) + 2
    n = -(-size // 8)
    seq = np.ones((len(own), words.shape[1] + 1), np.int64)  # 1 ends a part
    inside = np.arange(words.shape[1])[None, :] < n[:, None]
    seq[:, :-1][inside] = words[inside]
    take = np.concatenate([inside, np.zeros((len(own), 1), bool)], axis=1)
    take[np.arange(len(own)), n] = True
    start = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    is_start = np.full(int((n + 1).sum()), -1, np.int64)
    is_start[start] = np.arange(len(own))
    order = is_start[np.array(suffix_array(seq[take].tolist()), np.int64)]
    order = order[order >= 0]
    # parts of equal words but unequal length (zero bytes at an end) stand together; the shorter goes first
    far = np.zeros(len(own), np.int64)
    if len(own) > 1:
        a, b = order[:-1], order[1:]
        differ = grid[a] != grid[b]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        far[1:] = np.minimum(common, np.minimum(size[a], size[b]))
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return rank[which], far, size[order]


def _solve(slices: DataFrame, length: int, gram: int) -> DataFrame:
    """Slices -> spans (doc_id, twin, a, b) of their windows that also start earlier, by their bytes."""
    reach = length - gram + 1
    names = ["doc_id", "twin", "a", "b"]

    def differing(doc: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: list[bytes]):
        """(row, first and last distance) of runs of windows that also start earlier, by suffix arrays."""
        after = [x[h:] for x, h in zip(data, hi.tolist(), strict=True)]
        before = [x[:h][::-1] for x, h in zip(data, hi.tolist(), strict=True)]
        right, left = sort_parts(after, length), sort_parts(before, reach)
        early = np.lexsort((p, doc))
        when = np.empty(len(doc), np.int64)
        when[early] = np.cumsum(_runs(doc[early], p[early])) - 1
        flag = np.zeros((len(doc), reach), bool)
        for o in range(reach):
            own = np.flatnonzero((lo <= o) & (o <= hi))
            if len(own) < 2:
                continue
            r = np.cumsum(right[1] < length - o)[right[0][own]]
            k = np.cumsum(left[1] < o)[left[0][own]] if o else np.zeros(len(own), np.int64)
            sort = np.lexsort((when[own], k, r))
            new = _runs(r[sort], k[sort])
            head = np.maximum.accumulate(np.where(new, np.arange(len(sort)), 0))
            flag[own[sort], o] = when[own][sort] > when[own][sort][head]
        edge = np.diff(np.pad(flag, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        return row, begin, np.nonzero(edge == -1)[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got) if (got := list(batches)) else None
        if t is None or not t.num_rows:
            return
        group = np.unique(np.stack([t.column("gram").to_numpy(), t.column("part").to_numpy()]), axis=1, return_inverse=True)[1]
        doc, twin, at = (t.column(c).to_numpy() for c in ("doc_id", "twin", "at"))
        which = pc.dictionary_encode(t.column("bytes").combine_chunks())
        kind, distinct = which.indices.to_numpy(), which.dictionary
        p, lo, hi = at >> 16, (at >> 8) & 255, at & 255
        order = np.lexsort((p, doc, group))
        new = _runs(group[order])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        # groups of one slice, byte for byte: all windows of all but the first go
        odd = np.zeros(int(group.max()) + 1, bool)
        odd[group[order][(kind[order] != kind[head]) | (hi[order] != hi[head])]] = True
        k = order[((doc[order] != doc[head]) | (p[order] != p[head])) & ~odd[group[order]]]
        columns = [doc[k], twin[k], p[k] - hi[k], p[k] - lo[k] + length]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        # the others, whole groups at a time, by suffix arrays
        rest = order[odd[group[order]]]
        size = np.cumsum(_runs(group[rest])) if len(rest) else rest
        done = 0
        while done < len(rest):
            upto = min(len(rest), done + SOLVED)
            while upto < len(rest) and size[upto] == size[upto - 1]:
                upto += 1
            own = rest[done:upto]
            data = distinct.take(pa.array(kind[own])).to_pylist()
            row, begin, end = differing(doc[own], p[own], lo[own], hi[own], data)
            row = own[row]
            columns = [doc[row], twin[row], p[row] - end, p[row] - begin + length]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            done = upto

    return slices.mapInArrow(run, "doc_id long, twin long, a long, b long")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_twins(own: DataFrame) -> DataFrame:
    """own (doc_id, text) plus `twin`, which tells different texts of one doc_id apart; 0 where an id has but one.

    Texts are told apart by SHA-256 and numbered; the numbers are kept in the
    shared folder. Only ids that rows share are looked at.
    """
    shared = own.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if shared.isEmpty():
        return own.select("doc_id", F.lit(0).cast("long").alias("twin"), "text")
    sha = F.sha2("text", 256).alias("sha")
    kinds = own.join(shared, "doc_id", "left_semi").select("doc_id", sha).distinct()
    twins = cut(kinds.withColumn("twin", F.monotonically_increasing_id() + 1), "twins")
    keyed = own.select("doc_id", "text", sha)
    return keyed.join(twins, ["doc_id", "sha"], "left").select("doc_id", F.coalesce("twin", F.lit(0)).alias("twin"), "text")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, twin, text), (doc_id, twin, spans): what each document loses."""
    if not 0 < gram <= length <= 256 + gram - 1:
        raise ValueError("the gram must fit the length, and windows reach over 256 places at most")
    own = docs.select(node_id("doc_id").alias("doc_id"), text_of().alias("text"))
    own = _with_twins(own)
    found = cut(_meeting(_anchor_rows(own, length, gram), length, gram), "repeats")
    asked = found.where("open = 1").select("doc_id", "twin", "a", "b", "part")
    edges = _solve(_slices(own, asked, length), length, gram)
    spans = found.where("open = 0").select("doc_id", "twin", "a", "b").unionAll(edges)
    return own, spans.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept binary), a row for each row.

    Texts are UTF-8 bytes, null as empty; what is left may end within a
    character. Rows of one doc_id are one document to the order: no string of
    equal place there is earlier. A null doc_id comes first and is shown as
    null. An empty table gives no rows.
    """
    own, spans = repeated_spans(docs, length, gram)
    joined = own.join(spans.hint("shuffle_hash"), ["doc_id", "twin"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans_ in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = text.as_py().encode()
                lost = merge_spans([(x["a"], x["b"]) for x in spans_.as_py() or []])
                at, kept = 0, []
                for a, b in lost:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((len(data), sum(b - a for a, b in lost), len(lost), b"".join(kept)))
            if rows:
                n, removed, runs, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", shown_id("doc_id"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
