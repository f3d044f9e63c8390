"""Operator 8: token counts by a tokenizer compiled to a deterministic transducer.

The byte-level BPE and its splitter become one finite-state transducer over bytes whose transitions are
annotated with how many tokens they add to the count of the text read so far (a transition may take
tokens back: another letter can fuse two of them). It is determinised lazily: a state is made
when a text first reaches it, and its transition is a table look-up from then on.

* Splitter: start, inside a run of letters, digits or others, inside white space (whose last character
  may belong to the next run), and behind an apostrophe that may begin a contraction.
* BPE: every prefix of a piece has one last token, the token that ends there and is compatible with the
  last token of the prefix before it. What the future can ask about is only the places from which a
  token may still reach on, so a state holds the longest suffix that begins some token and, for
  each place in it, the last token there and the count relative to the end.

Behind a character that is not white space and a blank, the state is always the same one, ``gap``. A word
between two such blanks is therefore a transition from ``gap`` to ``gap`` with a fixed count. These are
compiled when first met: the splitter's pattern cuts the word, and each distinct piece is annotated once
with what the library's BPE model makes of it. The transitions by bytes serve everything else: starts,
ends, odd white space and the heads of chunks. For the same reason the state map of a chunk of text is constant behind its first such
place: a map is (head, end state, count), where only the head still waits for the state it starts in.
Maps compose associatively; a long document is cut into chunks that tasks evaluate apart, and its
maps are composed pairwise in a scan.

Defined cases: a null text is empty and has no token; a null id stays null; equal rows are counted each for
itself; an empty table gives no row; other columns are left out; special strings count as one token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.llm.common import as_bytes, narrow_batches, partitions
from threadwise.llm.tokens import _byte_letters

CHUNK = 64 << 10
START, RUN, SPACE, APOSTROPHE, MAYBE = range(5)
LETTER, DIGIT, OTHER, WHITE = range(4)
# The splitter of the vocabulary.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Added to the count of a word that does not lead back to the gap.
ASTRAY = 1 << 40


class Bpe:
    """Merges of a byte-level vocabulary. Ids of merged tokens ascend with the rank of their merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = {c: b for b, c in _byte_letters().items()}
        plain = lambda s: bytes(letter[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: Order of making: single bytes first, then merges by rank.
        self.token: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.fused: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        for a, b in pairs:
            left, right = plain(a), plain(b)
            made = self.token.setdefault(left + right, len(self.halves))
            if made == len(self.halves):
                self.halves.append((self.token[left], self.token[right]))
            self.fused.setdefault((self.token[left], self.token[right]), made)
        if len(vocab) < len(self.token):
            raise ValueError("the vocabulary lacks tokens of its merges")
        self.prefixes = {t[:k] for t in self.token for k in range(1, len(t) + 1)}
        self.special = [t["content"].encode() for t in spec["added_tokens"] if t["special"]]
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of a and b side by side is tokenised into just these two. Undo their merges
        from the latest: none of the pairs that met at the seam may have been fused before."""
        found = self.known.get((a, b))
        if found is None:
            x, y, bound, found = a, b, 1 << 60, True
            while True:
                made = self.fused.get((x, y))
                if made is not None and made < bound:
                    found = False
                    break
                hx, hy = self.halves[x], self.halves[y]
                if hx is None and hy is None:
                    break
                if hy is None or (hx is not None and x > y):
                    bound, x = x, hx[1]
                else:
                    bound, y = y + 1, hy[0]
            self.known[(a, b)] = found
        return found


class Transducer:
    """``step(state, byte)`` and the transitions of whole words. ``max_states`` and ``max_words`` bound
    the memory; a full table is begun anew, which changes no count."""

    def __init__(self, path: str, max_states: int = 150_000, max_words: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.bpe = Bpe(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = _byte_letters()
        self.cut_word = regex.compile(SPLITTER).findall
        self.max_states, self.max_words = max_states, max_words
        self.kinds = tuple(map(regex.compile, (r"\p{L}", r"\p{N}", r"\p{White_Space}")))
        self.kind_of: dict[bytes, int] = {}
        self.split_special = regex.compile(b"|".join(map(regex.escape, self.bpe.special)) or rb"(?!)")
        self.begin()

    def begin(self) -> None:
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.next: dict[int, int] = {}  # state << 8 | byte -> state << 8 | (tokens added + 128)
        self.contents: list[tuple] = []
        self.content_ids: dict[tuple, int] = {}
        self.content_next: dict[int, tuple[int, int]] = {}
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}
        self.root = self._content((b"", ((-1, 0),)))
        self.start = self._state((START, 0, self.root, -1, b""))
        self.gap = self._run(self.start, b"a ")[0]

    # -- BPE inside a piece

    def _content(self, key: tuple) -> int:
        at = self.content_ids.setdefault(key, len(self.contents))
        if at == len(self.contents):
            self.contents.append(key)
        return at

    def _feed_byte(self, content: int, byte: int) -> tuple[int, int]:
        found = self.content_next.get(content << 8 | byte)
        if found is None:
            suffix, places = self.contents[content]
            text, bpe = suffix + bytes((byte,)), self.bpe
            now = places[-1][1]
            for p in range(len(text)):
                token = bpe.token.get(text[p:])
                if token is not None and (places[p][0] < 0 or bpe.compatible(places[p][0], token)):
                    count = places[p][1] + 1
                    break
            else:
                raise AssertionError("no last token")
            cut = 0
            while text[cut:] not in bpe.prefixes:
                cut += 1
            kept = tuple((t, n - count) for t, n in places[cut:]) + ((token, 0),)
            found = self.content_next[content << 8 | byte] = (self._content((text[cut:], kept)), count - now)
        return found

    def _feed(self, content: int, char: bytes) -> tuple[int, int]:
        added = 0
        for byte in char:
            content, more = self._feed_byte(content, byte)
            added += more
        return content, added

    # -- splitter

    def _state(self, key: tuple) -> int:
        at = self.ids.setdefault(key, len(self.keys))
        if at == len(self.keys):
            self.keys.append(key)
        return at

    def _kind(self, char: bytes) -> int:
        kind = self.kind_of.get(char)
        if kind is None:
            text = char.decode("utf-8", "replace")
            letter, digit, white = (bool(k.match(text)) for k in self.kinds)
            kind = self.kind_of[char] = LETTER if letter else DIGIT if digit else WHITE if white else OTHER
        return kind

    def _open(self, char: bytes, kind: int) -> tuple[tuple, int]:
        """A character that is no white space, where a piece begins."""
        content, added = self._feed(self.root, char)
        return ((APOSTROPHE if char == b"'" else RUN), kind, content, -1, b""), added

    def _character(self, mode: int, kind: int, content: int, before: int, mark: bytes, char: bytes) -> tuple[tuple, int]:
        """(next state, tokens added). ``mark``: the last white space character, or the letter behind
        an apostrophe; ``before``: the content of the white space without its last character."""
        new = self._kind(char)
        if mode == APOSTROPHE:
            if char in (b"s", b"t", b"m", b"d"):
                return (START, 0, self.root, -1, b""), self._feed(content, char)[1]
            if char in (b"r", b"v", b"l"):
                _, added = self._feed(self.root, char)
                return (MAYBE, LETTER, content, -1, char), added
            mode = RUN  # the apostrophe is a run of others
            kind = OTHER
        elif mode == MAYBE:
            if char == (b"l" if mark == b"l" else b"e"):
                alone = self._feed(self.root, mark)[1]
                return (START, 0, self.root, -1, b""), self._feed(content, mark + char)[1] - alone
            mode, kind, content = RUN, LETTER, self._feed(self.root, mark)[0]
        if mode == SPACE:
            if new == WHITE:
                longer, added = self._feed(content, char)
                return (SPACE, WHITE, longer, content, char), added
            # All white space but its last character is a piece; the last one is dealt anew.
            last = self._feed(before, mark)[1]
            if mark == b" ":
                content, added = self._feed(self.root, b" " + char)
                return (RUN, new, content, -1, b""), added - last
            alone = self._feed(self.root, mark)[1]
            state, added = self._open(char, new)
            return state, added + alone - last
        if new == WHITE:
            content, added = self._feed(self.root, char)
            return (SPACE, WHITE, content, self.root, char), added
        if mode == RUN and new == kind:
            content, added = self._feed(content, char)
            return (RUN, kind, content, -1, b""), added
        return self._open(char, new)

    def step(self, state: int, byte: int) -> int:
        key = self.keys[state]
        part = key[5] if len(key) > 5 else b""
        char = part + bytes((byte,))
        need = 1 if char[0] < 0x80 else 2 if char[0] < 0xE0 else 3 if char[0] < 0xF0 else 4
        if len(char) < need:
            to, added = (*key[:5], char), 0
        else:
            to, added = self._character(*key[:5], char)
        found = self.next[state << 8 | byte] = self._state(to) << 8 | (added + 128)
        return found

    def _run(self, state: int, text: bytes) -> tuple[int, int]:
        known, count = self.next, 0
        for byte in text:
            to = known.get(state << 8 | byte)
            if to is None:
                to = self.step(state, byte)
            state = to >> 8
            count += (to & 255) - 128
        return state, count

    # -- texts

    def _piece(self, piece: str) -> int:
        self.pieces[piece] = n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        return n

    def _pieces(self, text: str) -> int:
        known = self.pieces
        return sum(known[p] if p in known else self._piece(p) for p in self.cut_word(text))

    def _ends_firmly(self, word: bytes) -> bool:
        """Whether the last character is there and is no white space."""
        if not word:
            return False
        at = len(word) - 1
        while at and word[at] & 0xC0 == 0x80:
            at -= 1
        return self._kind(word[at:]) != WHITE

    def _word(self, word: bytes) -> int:
        """The word from gap to gap, with the blank behind it."""
        if self._ends_firmly(word):
            count = self._pieces(" " + word.decode("utf-8", "replace"))
        else:
            count = self._run(self.gap, word + b" ")[1] + ASTRAY
        self.words[word] = count
        return count

    def run(self, state: int, text: bytes) -> tuple[int, int]:
        """(end state, tokens added) of a text without special strings."""
        words = text.split(b" ")
        if len(words) < 3:
            return self._run(state, text)
        state, count = self._run(state, words[0] + b" ")
        middle, known = words[1:-1], self.words
        if state == self.gap:
            for word in set(middle).difference(known):
                self._word(word)
            whole = sum(map(known.__getitem__, middle))
            if whole < ASTRAY:
                state, last = self._run(state, words[-1])
                return state, count + whole + last
        for word in middle:
            if state == self.gap and known.get(word, ASTRAY) < ASTRAY:
                count += known[word]
            else:
                state, more = self._run(state, word + b" ")
                count += more
        state, last = self._run(state, words[-1])
        return state, count + last

    def through(self, state: int, text: bytes) -> tuple[int, int]:
        """The same with special strings: each is one token, and the text begins anew behind it."""
        count, at = 0, 0
        for found in self.split_special.finditer(text):
            count += self.run(state, text[at : found.start()])[1] + 1
            state, at = self.start, found.end()
        state, more = self.run(state, text[at:] if at else text)
        return state, count + more

    def count(self, text: bytes) -> int:
        if self.full():
            self.begin()
        words = text.split(b" ")
        if len(words) < 3 or not (self._ends_firmly(words[0]) and self._ends_firmly(words[-1])) or self.split_special.search(text):
            return self.through(self.start, text)[1]
        known = self.words
        for word in set(words[1:]).difference(known):
            self._word(word)
        whole = sum(map(known.__getitem__, words[1:]))
        return whole + self._pieces(words[0].decode("utf-8", "replace")) if whole < ASTRAY else self.through(self.start, text)[1]

    def full(self) -> bool:
        return len(self.keys) + len(self.contents) > self.max_states or len(self.words) > self.max_words

    # -- state maps of chunks

    def state_map(self, chunk: bytes) -> tuple[bytes, tuple | None, int]:
        """(head, key of the end state, tokens behind the head). Behind the head the state is known
        whatever came before; without such a place all is head and the end state None."""
        import re

        reset = re.search(rb"[!-~] ", chunk)
        special = self.split_special.search(chunk)
        if special and not (reset and reset.end() <= special.start()):
            state, at, count = self.start, special.end(), 0
        elif reset:
            state, at, count = self.gap, reset.end(), 0
        else:
            return chunk, None, 0
        state, count = self.through(state, chunk[at:])
        return chunk[:at], self.name(state), count

    def compose(self, one: tuple, two: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if one[1] is None:
            return one[0] + two[0], two[1], two[2]
        state, count = self.through(self.named(one[1]), two[0])
        if two[1] is None:
            return one[0], self.name(state), one[2] + count
        return one[0], two[1], one[2] + count + two[2]

    def name(self, state: int) -> tuple:
        """A state as a value that another task's transducer understands."""
        mode, kind, content, before, mark, *part = self.keys[state]
        return mode, kind, self.contents[content], self.contents[before] if before >= 0 else None, mark, part[0] if part else b""

    def named(self, name: tuple) -> int:
        mode, kind, content, before, mark, part = name
        key = (mode, kind, self._content(content), self._content(before) if before is not None else -1, mark)
        return self._state((*key, part) if part else key)

    def total(self, maps: list[tuple]) -> int:
        """Tokens of a document from the maps of its chunks, composed pairwise, round by round."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, _, count = maps[0]
        return self.through(self.start, head)[1] + count


def chunks(text: bytes, size: int, special: list[bytes]) -> Iterator[bytes]:
    """Cut a text about every ``size`` bytes, not inside a character or a special string."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        for s in special:
            found = text.find(s, max(at, cut - len(s) + 1), cut + len(s) - 1)
            if found >= 0 and found < cut:
                cut = found + len(s)
        while cut < len(text) and text[cut] & 0xC0 == 0x80:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count_short(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(path)
        for batch in narrow_batches(batches, "text"):
            texts = as_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([machine.count(t) for t in texts], pa.int64())], schema=schema)

    return run


def _cut_long(path: str, size: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("place", pa.int64()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = Bpe(path).special
        for batch in narrow_batches(batches, "text"):
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                cut = list(chunks(text, size, special))
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([doc_id] * n, pa.int64()), pa.array([len(text)] * n), pa.array(range(n), pa.int64()), pa.array(cut, pa.binary())], schema=schema)

    return run


def _map_chunks(path: str):
    import pickle

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("place", pa.int64()), ("map", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(path)
        for batch in narrow_batches(batches, "chunk"):
            maps = []
            for chunk in batch.column(4).to_pylist():
                maps.append(pickle.dumps(machine.state_map(chunk)))
                if machine.full():
                    machine.begin()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(maps, pa.binary())], schema=schema)

    return run


def _compose_rows(path: str):
    import pickle

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, row, about, maps = Transducer(path), None, None, []
        out: list[tuple] = []
        for batch in batches:
            for new, doc_id, n_bytes, _, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if new != row:
                    if maps:
                        out.append((*about, machine.total(maps)))
                    row, about, maps = new, (doc_id, n_bytes), []
                maps.append(pickle.loads(packed))
                if len(maps) >= 1024:  # what is known so far is one map
                    while len(maps) > 1:
                        maps = [machine.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if maps:
            out.append((*about, machine.total(maps)))
        columns = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_tokens). Documents of up to ``chunk`` bytes are counted where they are read; longer
    ones are cut, their chunks dealt over all tasks, and only the maps of a document meet again."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    result = "doc_id long, n_bytes long, n_tokens long"
    short = rows.where(F.octet_length("text") <= chunk).mapInArrow(_count_short(vocabulary), result)
    long = rows.where(F.octet_length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = long.mapInArrow(_cut_long(vocabulary, chunk), "row long, doc_id long, n_bytes long, place long, chunk binary")
    maps = cut.repartition(n, "row", "place").mapInArrow(_map_chunks(vocabulary), "row long, doc_id long, n_bytes long, place long, map binary")
    whole = maps.repartition(n, "row").sortWithinPartitions("row", "place").mapInArrow(_compose_rows(vocabulary), result)
    return short.unionByName(whole).withColumnRenamed("doc_id", id_col)
