"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming UTF-8 decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours, encoded alone, stay
two tokens.  So the encoder is a nondeterministic transducer that reads bytes and guesses token ends, with
the last token as memory; after every byte exactly one guess has just ended a valid encoding, the others
are beginnings of longer tokens.  States of the deterministic machine are sets of such guesses, made when
first met and remembered, each guess with the tokens it has beyond those that all guesses share.  Shared
tokens are emitted at once; no guess reaches back further than the longest token, which bounds the
lookahead.  States, pair decisions and encoded pieces are remembered up to fixed counts and made anew after.

Texts are cut into pieces by the vocabulary's pattern and every piece is encoded separately.  A piece that
is a token as a whole is that token.

Defined results: null and empty texts give no ids; no ids decode to an empty text; byte sequences that are
not UTF-8 decode to U+FFFD for each broken part; repeated rows get equal results; ids outside the
vocabulary are an error.  Only the named column is read.
"""

import base64
import gc
from array import array
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillgate.llm.store import small_batches
from quillgate.llm.words import give_back, held

#: Most remembered states, token pairs and pieces of one task.
MOST_STATES = 300_000
MOST_PAIRS = 100_000
MOST_PIECES = 60_000
#: Characters of text encoded together, and bytes from which a piece is read on its own.
PASS_CHARS = 1 << 19
LONG_PIECE = 256
#: Most bytes of a rank file.
MOST_RANK_BYTES = 64 << 20


def read_ranks(path):
    """Ranks of a file of "base64 rank" lines, whose size is checked since every task holds it."""
    with open(path, "rb") as file:
        raw = file.read(MOST_RANK_BYTES + 1)
    if len(raw) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def merges(ranks, piece, parts=None):
    """Repeated merging of the leftmost pair of lowest rank: (rank, first part if it ends here, last part if it ends here)."""
    parts = [] if parts is None else parts
    parts[:] = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        yield best, parts[0] if at == 0 else None, parts[-1] if at == len(parts) - 2 else None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


def merged(ranks, piece):
    """Encoding of a short byte string by merging alone."""
    parts = []
    for _ in merges(ranks, piece, parts):
        pass
    return [ranks[p] for p in parts]


@contextmanager
def _no_collection():
    """No search for reference cycles meanwhile: many small tuples are made here, and none holds itself."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class Encoder:
    """Texts to token ids; pieces that are not remembered go through the transducer."""

    def __init__(self, ranks, pattern):
        self.ranks, self.cut, self.known_ids, self.older_ids, self.edges, self.pairs = ranks, _pieces(pattern), {}, {}, {}, {}
        self.never = max(ranks.values()) + 1
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.words_first = pattern == WORDS_FIRST
        # a tree of all token beginnings: node 0 is empty; child by node and byte, token by node (-1: none)
        self.child, self.token_at, self.inner = {}, [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token_at[node] = rank
        self._forget()

    def _forget(self):
        """Start anew with the initial state alone: one guess, nothing read, nothing emitted."""
        self.states, self.numbers, self.steps, self.finals = [], {}, {}, array("q")
        self.outputs, self.output_numbers = [()], {(): 0}
        self.known = np.zeros((3, 0), np.int64)  # sorted step keys, next states, outputs
        self._number((-1, 0, 0))

    def _number(self, state):
        """Number of a state: its last token, then (tree node, output) of each guess, the one that just ended last."""
        packed = array("i", state).tobytes()
        if packed not in self.numbers:
            self.numbers[packed] = len(self.states)
            self.states.append(packed)
            self.finals.append(state[-1])
        return self.numbers[packed]

    def _output(self, tokens):
        """Number of a token sequence."""
        if tokens not in self.output_numbers:
            self.output_numbers[tokens] = len(self.outputs)
            self.outputs.append(tokens)
        return self.output_numbers[tokens]

    def _edges(self, token):
        """What stands at the left and at the right end of a token while it is merged, each with the rank that ends it."""
        if token not in self.edges:
            raw = self.bytes_of[token]
            left, right = [], []
            for merge, first, last in merges(self.ranks, raw):
                left += [(first, merge)] * (first is not None)
                right += [(last, merge)] * (last is not None)
            grows = all(x < y for side in (left, right) for (_, x), (_, y) in zip(side, side[1:]))
            plain = grows and merged(self.ranks, raw) == [token]
            self.edges[token] = ([*left, (raw, self.never)], [*right, (raw, self.never)]) if plain else None
        return self.edges[token]

    def _follows(self, before, token):
        """May ``token`` stand right after ``before``: does no merge cross the border before both are whole?"""
        if before < 0:
            return True
        key = before << 32 | token
        if key not in self.pairs:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            a, b = self._edges(before), self._edges(token)
            if a is None or b is None:  # ranks that do not grow with the merges: encode the pair
                self.pairs[key] = merged(self.ranks, self.bytes_of[before] + self.bytes_of[token]) == [before, token]
            else:
                self.pairs[key] = not self._crossed(a[1], b[0])
        return self.pairs[key]

    def _crossed(self, right, left):
        """Does a part at the right end of a token merge with one at the left end of the next before both have ended?"""
        get = self.ranks.get
        for x, used_x in right:
            for y, used_y in left:
                rank = get(x + y)
                if rank is not None and rank < used_x and rank <= used_y:
                    return True
        return False

    def _step(self, number, byte):
        """Next state, and the number of the tokens emitted on the way."""
        flat = array("i", self.states[number])
        child, outputs, token_at, inner, pairs = self.child.get, self.outputs, self.token_at, self.inner, self.pairs.get
        last, after, ended, free = flat[0], [], None, False
        for i in range(1, len(flat), 2):
            node = child(flat[i] << 8 | byte)
            if node is None:
                continue
            output, token = flat[i + 1], token_at[node]
            if token >= 0 and ended is None:
                pending = outputs[output]
                before = pending[-1] if pending else last
                follows = pairs(before << 32 | token)
                if follows or follows is None and self._follows(before, token):
                    ended = (*pending, token)  # one guess alone ends a valid encoding here
            if inner[node]:
                after += (node, output)
                free = free or not output
        if not after:  # nothing else can begin here: all tokens are settled
            return self._number((ended[-1], 0, 0)), self._output(ended)
        if free:  # a guess without tokens of its own shares none with the others
            return self._number([last, *after, 0, self._output(ended)]), 0
        held_back = [outputs[output] for output in after[1::2]]
        first, shortest, same = held_back[0], min(len(ended), min(map(len, held_back))), 0
        while same < shortest and ended[same] == first[same] and all(pending[same] == first[same] for pending in held_back):
            same += 1
        if same:
            last = first[same - 1]
        if shortest > same:
            last = -2  # every guess carries its own last token
        state = [last]
        for node, output, pending in zip(after[::2], after[1::2], held_back):
            state += (node, self._output(pending[same:]) if same else output)
        state += (0, self._output(ended[same:]))
        return self._number(state), self._output(first[:same])

    def transduce(self, piece):
        """Token ids of one piece, byte by byte."""
        state, out, steps = 0, [], self.steps
        for byte in piece:
            found = steps.get(state << 8 | byte)
            if found is None:
                if len(self.states) >= 2 * MOST_STATES:  # within one very long piece: keep only where it stands
                    last, *flat = array("i", self.states[state])
                    guesses = [(node, self.outputs[n]) for node, n in zip(flat[::2], flat[1::2])]
                    self._forget()
                    state = self._number([last, *chain.from_iterable((node, self._output(p)) for node, p in guesses)])
                    steps = self.steps
                steps[state << 8 | byte] = found = self._step(state, byte)
            state, emitted = found
            out += self.outputs[emitted]
        return out + list(self.outputs[self.finals[state]])

    def transduce_many(self, pieces):
        """Token ids of many pieces: all of them read their next byte at once, known steps by binary search."""
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8).astype(np.int64)
        size = size[order]
        start = np.cumsum(size) - size
        state = np.zeros(len(pieces), np.int64)
        owners, outputs, fresh = [], [], {}
        for k in range(int(size[0]) if len(size) else 0):
            on = int(np.searchsorted(-size, -k, side="left"))  # longer than k
            key = state[:on] << 8 | data[start[:on] + k]
            at = np.minimum(np.searchsorted(self.known[0], key), max(self.known.shape[1] - 1, 0))
            hit = self.known[0][at] == key if self.known.shape[1] else np.zeros(on, bool)
            found = self.known[1:, at] if self.known.shape[1] else np.zeros((2, on), np.int64)
            if not hit.all():
                news, where = np.unique(key[~hit], return_inverse=True)
                for new in news.tolist():
                    if new not in fresh:
                        fresh[new] = self._step(new >> 8, new & 255)
                found[:, ~hit] = np.array([fresh[n] for n in news.tolist()]).T[:, where]
            state[:on] = found[0]
            some = np.flatnonzero(found[1])
            owners.append(some)
            outputs.append(found[1][some])
        if fresh:
            rows = np.array([(key, *value) for key, value in sorted(fresh.items())]).T
            self.known = np.insert(self.known, np.searchsorted(self.known[0], rows[0]), rows, axis=1)
        owners.append(np.arange(len(pieces)))
        outputs.append(np.frombuffer(self.finals, np.int64)[state])
        owner, output = np.concatenate(owners), np.concatenate(outputs)
        by_piece = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_piece], np.arange(len(pieces) + 1)).tolist()
        emitted = [self.outputs[n] for n in output[by_piece].tolist()]
        out = [None] * len(pieces)
        for i, place in enumerate(order.tolist()):
            lo, hi = cuts[i], cuts[i + 1]
            out[place] = emitted[lo] if hi == lo + 1 else tuple(chain.from_iterable(emitted[lo:hi]))
        return out

    def _unknown(self, pieces):
        """The pieces whose ids are not remembered; those of the older half come over to the newer one."""
        missing = pieces.difference(self.known_ids)
        again = [x for x in missing if x in self.older_ids]
        self.known_ids.update(zip(again, map(self.older_ids.__getitem__, again)))
        missing.difference_update(again)
        return missing

    def _learn_pieces(self, texts):
        """Remember the ids of pieces that are not known yet."""
        rest = []
        for text in texts:
            piece = text.encode("utf-8")
            whole = self.ranks.get(piece)
            if whole is not None:
                self.known_ids[text] = (whole,)
            elif len(piece) > LONG_PIECE:
                self.known_ids[text] = tuple(self.transduce(piece))
            else:
                rest.append((text, piece))
        if rest:
            texts, pieces = zip(*rest)
            self.known_ids.update(zip(texts, self.transduce_many(pieces)))

    def _learn(self, words):
        """Remember the ids of words that are not known yet."""
        single, parts = set(), {}
        for word in words:
            if word.isalpha() or word[1:].isalpha() and word[0] == " ":  # one piece
                single.add(word)
                continue
            core = word[:-1]
            if word[-1:] in ENDS and (core.isalpha() or core[1:].isalpha() and core[0] == " "):  # one piece and a mark
                parts[word] = (core, word[-1])
            else:
                parts[word] = self.cut(word)
        self._learn_pieces(self._unknown(single.union(*parts.values())))
        get = self.known_ids.__getitem__
        self.known_ids.update([(word, tuple(chain.from_iterable(map(get, pieces)))) for word, pieces in parts.items()])

    def encode_many(self, texts):
        """Token ids of whole texts.

        With the pattern WORDS_FIRST, a lone white-space character between others starts a piece and a lone space
        stays with what follows, so texts whose white space is lone blanks and line ends between words may be cut
        there first.

        Pieces are remembered in two halves: when the newer one is full it becomes the older one, and what is
        used again comes over, so frequent pieces stay.
        """
        with _no_collection():
            return self._encode_many(texts)

    def _encode_many(self, texts):
        if len(self.states) >= MOST_STATES:
            self._forget()
        if len(self.known_ids) > MOST_PIECES:
            self.known_ids, self.older_ids = {}, self.known_ids
        cut, words, pieces = [], set(), set()
        for text in texts:
            if self.words_first and "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
                cut.append(text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))
                words.update(cut[-1])
            else:
                cut.append(self.cut(text))
                pieces.update(cut[-1])
        self._learn(self._unknown(words))
        self._learn_pieces(self._unknown(pieces))
        get = self.known_ids.__getitem__
        return [list(chain.from_iterable(map(get, parts))) for parts in cut]


class Decoder:
    """Tokens to text, one after the other; an unfinished character waits for the tokens that end it."""

    def __init__(self, ranks):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.whole = {}
        for rank, token in self.bytes_of.items():
            text, state = self.feed(token, START)
            if state == START and "�" not in text:
                self.whole[rank] = text

    @staticmethod
    def feed(data, state):
        """Text of some bytes and the state after them."""
        need, low, high, code = state
        out = []
        for byte in data:
            if need:
                if low <= byte <= high:
                    need, code, low, high = need - 1, code << 6 | byte & 0x3F, 0x80, 0xBF
                    if not need:
                        out.append(chr(code))
                    continue
                out.append("�")
                need = 0
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                need, code, low, high = 1, byte & 0x1F, 0x80, 0xBF
            elif 0xE0 <= byte <= 0xEF:
                need, code, low, high = 2, byte & 0x0F, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                need, code, low, high = 3, byte & 0x07, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out), (need, low, high, code) if need else START

    def decode(self, ids):
        """Text of a token sequence."""
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            pass
        out, state, whole = [], START, self.whole
        for token in ids:
            text = whole.get(token)
            if state is not START or text is None:
                text, state = self.feed(self.bytes_of[token], state)
            out.append(text)
        if state is not START:
            out.append("�")
        return "".join(out)


#: The pattern of contractions, letters, numbers, other marks and white space for which words may be cut first.
WORDS_FIRST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks that are a piece of their own behind a letter at the end of a word.
ENDS = frozenset(".,;:!?")

#: Bytes awaited, the allowed range of the next one, and the bits so far.
START = (0, 0, 0, 0)


def _machines(ranks, pattern):
    """The worker's encoder and decoder of a vocabulary."""
    return held(("bpe", pattern, hash(frozenset(ranks.items()))), lambda: (Encoder(ranks, pattern), Decoder(ranks)))


def _pieces(pattern):
    import regex

    # Unicode white space alone, without the separators U+001C to U+001F
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
        r"\S", r"\P{White_Space}")).findall


def _encoded(encoder, column):
    """Token ids of the texts of an Arrow column, in lists of some megabytes of text."""
    part, size = [], 0
    for value in column:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= PASS_CHARS:
            yield encoder.encode_many(part)
            part, size = [], 0
    if part:
        yield encoder.encode_many(part)


def _id_lists(many):
    cuts = np.zeros(len(many) + 1, np.int32)
    np.cumsum([len(ids) for ids in many], out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.fromiter(chain.from_iterable(many), np.int32, int(cuts[-1]))))


def coded(docs, ranks, pattern, text_column="text"):
    """The table with ``ids`` (array<int>) and ``decoded`` (the text these ids decode to); columns of these names are replaced."""
    small_batches(docs.sparkSession)
    sent = _broadcast(ranks)
    docs = docs.drop("ids", "decoded")
    place = docs.columns.index(text_column)
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches):
        give_back()  # what earlier work of this worker has left
        encoder, decoder = _machines(sent.value, pattern)
        for batch in batches:
            give_back()
            lo = 0
            for many in _encoded(encoder, batch.column(place)):
                rows = batch.slice(lo, len(many))
                lo += len(many)
                found = [_id_lists(many), pa.array([decoder.decode(ids) for ids in many], pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *found], [*rows.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def encoded(ranks, pattern, text_column):
    """array<int> of every whole text."""
    sent = _broadcast(ranks)

    @F.arrow_udf("array<int>")
    def of(text: pa.Array) -> pa.Array:
        encoder, _ = _machines(sent.value, pattern)
        parts = [_id_lists(many) for many in _encoded(encoder, text)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return of(text_column)


def decoded(ranks, ids_column):
    """Text of every array of ids; null counts as no ids."""
    sent = _broadcast(ranks)

    @F.arrow_udf("string")
    def of(ids: pa.Array) -> pa.Array:
        decoder = held(("ids", hash(frozenset(sent.value.items()))), lambda: Decoder(sent.value))
        return pa.array([decoder.decode(v.as_py() or []) for v in ids], pa.string())

    return of(ids_column)


def _broadcast(ranks):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(ranks)
