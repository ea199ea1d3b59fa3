"""Packing documents into training sequences by bin completion.

Only the number of pieces of each length matters for a packing, so the search works on a histogram of at most
`capacity` lengths, however many documents there are. It is a depth-first bin completion: take the largest
length left, enumerate the undominated fillings of the rest of its sequence (a filling is dominated if some of its
pieces can give way to one larger piece), apply one as often as the counts allow, and go on. Best-fit decreasing
gives the first incumbent; only fillings are listed whose waste can still beat the incumbent. The plan (a list of
fillings with their multiplicity) is then dealt to the pieces by their rank among equal lengths, which is found
without gathering a length in one task.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

CAPACITY = 2048
#: Words and pieces in each of the two generations of a tokenizing process's memory; texts whose words are looked up together.
CACHE, GROUP = 100_000, 256
#: Runs of ASCII punctuation that stand between white space, letters and digits, and apart from apostrophes: pieces of
#: their own, as are runs of ASCII letters and single digits.
_APART = re.compile(r"([!-&(-/:-@\[-`{-~](?<![^ \t\n\r\x0b\x0c\w].)(?<!_.)[!-&(-/:-@\[-`{-~]*+)(?=[ \t\n\r\x0b\x0c]|[^\W_]|\Z)")
#: Letters that become another letter, or more than one, in the context of a word or by themselves.
_ODD = re.compile("[\u0130\u03a3]")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself if it is a visible Latin-1
    character, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Token ids (little-endian unsigned 32-bit) of text without ASCII white space. Of what is remembered, the entries used
    since the last turn stay when the memory is full.

    The vocabulary's pre-tokenizer drops white space and takes runs of letters, single digits and runs of all else apart,
    and no token spans two of its pieces. So a text's ids are those of its pieces in turn. Unknown pieces are tokenized
    together by the vocabulary's model alone: each ends with the only token that closes a piece. What isn't surely one or
    more such pieces (with apostrophes, marks, symbols beyond ASCII) goes through the whole tokenizer, word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.closes = np.zeros(size, bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = [_byte_letters()[b] for b in range(256)]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.ids(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def split(self, text: str | None) -> list[str]:
        """The text's words, lower-cased and apart from their punctuation where that is sure to give the same ids."""
        if not text:
            return []
        if "|>" in text and any(t in text for t in self.added):
            return [text]
        plain = text.isascii()
        if not plain and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if plain or not _ODD.search(text):
            text = _APART.sub(r" \1 ", text.lower())
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, words: set[str]) -> None:
        """Remember the ids of all short words among these."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE:
            self.older = dict(self)
            self.clear()
            self[""] = b""
            new = words
        older = self.older
        self.update({w: older[w] for w in new if w in older})
        plain = [w for w in new if w not in self and len(w) <= 64 and w.isalpha() and w.islower()]
        if plain:
            shown = (w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())) for w in plain)
            ids = np.asarray(self.model.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                self.update(zip(plain, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:  # some word is more than one piece
                self.update((w, self.ids(w)) for w in plain)


#: The words of this process, by vocabulary file; a worker keeps them from task to task.
_KNOWN: dict[str, _Words] = {}


def token_bytes(words: _Words, texts: list[str | None], end: bytes) -> Iterator[bytes]:
    """Ids of each whole text and the end id."""
    parts = [*map(words.split, texts)]
    words.learn(set().union(*parts))
    for p in parts:
        yield b"".join(map(words.__getitem__, p)) + end


def cut(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null text counts as empty (one end id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
        if path not in _KNOWN:
            _KNOWN[path] = _Words(path)
        words = _KNOWN[path]
        end, wide = np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for pdf in batches:
            rows = []
            texts = list(pdf["text"])
            found = (x for i in range(0, len(texts), GROUP) for x in token_bytes(words, texts[i : i + GROUP], end))
            for doc_id, ids in zip(pdf["doc_id"], found, strict=True):
                rows += [(doc_id, at // wide, at // 4, min(wide, len(ids) - at) // 4, zlib.crc32(ids[at : at + wide])) for at in range(0, len(ids), wide)]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        words.older = {}  # the process may go on with other work

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on a histogram: [(((length, pieces), ...), bins), ...]. Bins of equal rest are handled together."""
    rests: dict[int, list] = {}
    done: list[tuple[tuple, int]] = []

    def put(rest: int, filling: tuple, n: int) -> None:
        if n <= 0:
            return
        if rest == 0:
            done.append((filling, n))
        else:
            rests.setdefault(rest, []).append((filling, n))

    for size, count in sorted(((int(s), int(c)) for s, c in zip(sizes, counts, strict=True) if c), reverse=True):
        for rest in sorted(r for r in rests if r >= size):
            each = rest // size
            while count and rests.get(rest):
                filling, n = rests[rest].pop()
                full = min(n, count // each)
                put(rest - each * size, (*filling, (size, each)), full)
                count -= full * each
                n -= full
                if n and count:
                    put(rest - count * size, (*filling, (size, count)), 1)
                    n, count = n - 1, 0
                if n:
                    rests[rest].append((filling, n))
            if not rests.get(rest):
                rests.pop(rest, None)
            if not count:
                break
        if count:
            each = capacity // size
            put(capacity - each * size, ((size, each),), count // each)
            if count % each:
                put(capacity - count % each * size, ((size, count % each),), 1)
    return done + [x for xs in rests.values() for x in xs]


def size_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs: the largest of the sum bound and, for each cut k, the bound that counts
    pieces over capacity - k apart, those over half the capacity one by one, and fills the rest with pieces of k or more."""
    live = counts > 0
    s, c = sizes[live].astype(np.int64), counts[live].astype(np.int64)
    if not len(s):
        return 0
    best = -(-int((s * c).sum()) // capacity)
    for k in np.unique(s[s <= capacity // 2]):
        one, two, three = s > capacity - k, (s > capacity // 2) & (s <= capacity - k), (s >= k) & (s <= capacity // 2)
        n1, n2 = int(c[one].sum()), int(c[two].sum())
        room = n2 * capacity - int((s[two] * c[two]).sum())
        best = max(best, n1 + n2 + max(0, -(-(int((s[three] * c[three]).sum()) - room) // capacity)))
    return max(best, int(c[s > capacity // 2].sum()))


class _Steps:
    """Steps of a search that are left."""

    def __init__(self, left: int):
        self.left = left

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def dominated(filling: tuple, rest: int, sizes: list[int], free: dict[int, int]) -> bool:
    """Whether some pieces of a filling could give way to one larger free piece, or to one of their joint length, and the
    filling still fits: what is left over then packs no worse. Of long fillings only sets of up to two pieces are tried."""
    room = rest - sum(filling)
    tried = set()
    for n in range(len(filling) + 1 if len(filling) <= 10 else 3):
        for part in combinations(filling, n):
            if part in tried:
                continue
            tried.add(part)
            low = sum(part)
            i = bisect.bisect_left(sizes, low + (n < 2))
            while i < len(sizes) and sizes[i] <= low + room:
                if free[sizes[i]] > filling.count(sizes[i]):
                    return True
                i += 1
    return False


def fillings(rest: int, sizes: list[int], free: dict[int, int], waste: int, steps: _Steps) -> Iterator[tuple]:
    """The undominated fillings of `rest` that waste `waste` at most, fullest first, while steps are left.

    sizes: lengths on hand, ascending; free: pieces of each.
    """
    below = [0]
    for x in sizes:
        below.append(below[-1] + x * free[x])
    for total in range(rest, max(0, rest - waste) - 1, -1):
        # exact sums by depth-first search, larger pieces first: (lengths still allowed, sum to reach, pieces so far)
        stack = [(bisect.bisect_right(sizes, total), total, ())]
        while stack:
            if not steps.take():
                return
            top, need, found = stack.pop()
            if not need:
                if not dominated(found, rest, sizes, free):
                    yield found
                continue
            top = min(top, bisect.bisect_right(sizes, need))
            if below[top] < need or not top:
                continue
            x = sizes[top - 1]
            stack.append((top - 1, need, found))
            stack += [(top - 1, need - n * x, found + (x,) * n) for n in range(1, min(free[x], need // x) + 1)]


def bin_completion(sizes: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, nodes: int = 200_000) -> tuple[list[tuple[tuple, int]], bool]:
    """The best plan found within `nodes` steps of the search, [(((length, pieces), ...), bins), ...], and whether it is
    known to be the best: because it meets the size bound, or because the search ended by itself.

    At a node the largest length left is completed by each undominated filling, as often as the counts allow and then ever
    fewer times; a filling that was tried isn't used again for that length below the node, as those plans were seen.
    """
    incumbent = best_fit(sizes, counts, capacity)
    least, bins = size_bound(sizes, counts, capacity), sum(n for _, n in incumbent)
    if bins <= least:
        return incumbent, True
    total = sum_left = int((sizes.astype(np.int64) * counts.astype(np.int64)).sum())
    left = {int(s): int(c) for s, c in zip(sizes, counts, strict=True) if c}
    order, used, steps = sorted(left), 0, _Steps(nodes)

    def move(filling: tuple, times: int) -> None:
        """Pack pieces, or with negative times take them back."""
        nonlocal sum_left, used
        used += times
        for x in filling:
            if x not in left:
                left[x] = 0
                bisect.insort(order, x)
            left[x] -= times
            sum_left -= x * times
            if not left[x]:
                del left[x]
                order.pop(bisect.bisect_left(order, x))

    def node(above: dict | None) -> dict:
        big = order[-1]
        free = dict(left)
        free[big] -= 1
        waste = (bins - 1) * capacity - total - (used * capacity - (total - sum_left))
        seen = set(above["seen"]) if above and above["big"] == big else set()
        return {"big": big, "more": fillings(capacity - big, [x for x in order if free[x]], free, waste, steps) if waste >= 0 else iter(()), "seen": seen, "now": None, "times": 0}

    trail = [node(None)]
    while trail and bins > least:
        at = trail[-1]
        if at["times"]:
            move(at["now"], -at["times"])
            at["times"] -= 1
        if not at["times"]:
            at["now"] = next((f for f in ((at["big"], *f) for f in at["more"]) if f not in at["seen"]), None)
            if at["now"] is None:
                trail.pop()
                continue
            at["seen"].add(at["now"])
            at["times"] = min(left[x] // at["now"].count(x) for x in set(at["now"]))
        move(at["now"], at["times"])
        if order:
            trail.append(node(at))
        elif used < bins:
            bins, incumbent = used, [(tuple((x, n["now"].count(x)) for x in dict.fromkeys(n["now"])), n["times"]) for n in trail]
    return incumbent, bins <= least or steps.left >= 0


def slots(plan: list[tuple[tuple, int]]) -> pd.DataFrame:
    """Where the pieces of each length go: ranks first .. first + n * per - 1 fill n sequences from sequence `bin` on, per in each, at `offset`."""
    used: dict[int, int] = {}
    rows, at = [], 0
    for filling, n in plan:
        offset = 0
        for length, per in filling:
            rows.append((length, used.get(length, 0), per, at, offset))
            used[length] = used.get(length, 0) + per * n
            offset += per * length
        at += n
    return pd.DataFrame(rows, columns=["length", "first", "per", "bin", "offset"], dtype=np.int64).sort_values(["length", "first"], ignore_index=True)


def ranked(pieces: DataFrame, salts: int = 256) -> DataFrame:
    """pieces with `rank`, 0, 1, ... among those of equal length, by salt and then doc_id and piece. No length is
    gathered in one task: ranks within a salt are shifted by the counts of the salts before it. The more salts, the smaller
    are the groups of a length and salt."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("salt", "shift")


def place(pieces: DataFrame, plan: list[tuple[tuple, int]]) -> DataFrame:
    """pieces with sequence_id and offset. The slots are broadcast: there are at most a few tens of thousands, bounded by the capacity."""
    shared = pieces.sparkSession.sparkContext.broadcast(slots(plan).to_numpy())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        keys = table[:, 0] << 40 | table[:, 1]
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            slot = table[np.searchsorted(keys, pdf["length"].to_numpy(np.int64) << 40 | rank, side="right") - 1]
            inside = rank - slot[:, 1]
            out = pdf[names].assign(doc_id=pdf["doc_id"].astype("Int64"))
            yield out.assign(sequence_id=slot[:, 3] + inside // slot[:, 2], offset=slot[:, 4] + inside % slot[:, 2] * slot[:, 0])

    return pieces.select(*names, "rank").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id. Repeated rows are packed as often as they come; ties are broken by
    doc_id and piece; a null doc_id stays null. An empty table gives an empty result. Full pieces of `capacity`
    ids fill a sequence each.
    """
    pieces = materialize(cut(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = np.array([tuple(r) for r in pieces.groupBy("length").count().collect()], np.int64).reshape(-1, 2)  # at most `capacity` rows
    salts = max(256, int(histogram[:, 1].max(initial=0)) >> 16)  # some 65536 pieces of a length and salt
    return place(ranked(pieces, salts), bin_completion(histogram[:, 0], histogram[:, 1], capacity)[0])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
