"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The patterns (:func:`base_spans`) are matched leftmost and non-overlapping per kind. The field labels words as outside, or as the begin or the inside of an email, ip, card or
phone, from the shapes of a word and its neighbours; it is trained on ``LABELLED``, a small table of marked sentences
with drawn digits, and finds phone numbers without a country code, spelled-out addresses, and card numbers and
addresses announced by a word. Of each of its spans the words that no pattern's span touches are added.

Only words near one with a digit, an at sign or a bracketed word matter: a sequence is a run of words within
``NEAR`` words of such a one, cut after ``LONGEST`` words. Sequences of like length are decoded together by Viterbi.

Defined cases: a null or empty text has no span; texts are read whole; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ringfence.llm.kernels import pieces, words
from ringfence.session import cut

KINDS = ("email", "ip", "card", "phone")
NEAR, LONGEST = 3, 256
LABELS = 2 * len(KINDS) + 1

# The patterns of the contract. Possessive repeats match the same and never go back.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMERIC = re.compile(r"[0-9][0-9 .-]*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of every accepted match, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for region in NUMERIC.finditer(text):  # both kinds lie in runs of their characters
        a, b = region.span()
        if b - a < 7:
            continue
        part = region.group()
        out += [(a + m.start(), 1, a + m.end()) for m in IP.finditer(part) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(part):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((a + m.start(), 2, a + m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


# The labelled table: {kind:text} marks personal data, # stands for a digit drawn by seed.
LABELLED = """
you can reach me on {phone:(###) ###-####} any time
the office number is {phone:###-###-####} and it is open
{phone:(###) ###-####} is the line of the front desk
please ring {phone:###-####-####} or come by
fax {phone:(###) ###-####.} is for orders only
call {phone:###.###.####} before noon
phone {phone:#### ### ####} for the shop
his tel {phone:(##) #### ####} never answers
lines {phone:(###) ###-####}, {phone:(###) ###-####}, {phone:(###) ###-####} are open
lines {phone:(###) ###-####} {phone:(###) ###-####} are open
lines {phone:###-###-####}, {phone:###-###-####} {phone:(###) ###-####} {phone:###-###-####} are open
lines {phone:###.###.####} {phone:###.###.####} are open
mail {email:ann## (at) example (dot) com} {email:bob (at) example (dot) org} or both
mail {email:ann [at] example [dot] com}, {email:bob## [at] example [dot] org} or both
the cards {card:#### #### #### ####}, {card:#### #### #### ####} were refused
numbers {phone:(###)###-####} and {phone:###-###-####} are both hers
write to {email:jane.doe (at) mail (dot) example (dot) org} for more
send it to {email:sales [at] example [dot] com} today
his address {email:tom (at) host (dot) net} has changed
{email:info [at] shop [dot] example [dot] com} is read daily
mail {email:ann## (at) example (dot) com} and {email:bob (at) example (dot) org}
the card {card:#### #### #### ####} was refused
pay with card {card:####-####-####-####} now
the | of | ################ | and | them |
and*** ################$$$ the%%%
his card number {card:#### ###### #####} is known
ip {ip:##.###.##.##} was blocked
from ip {ip:2##.###.#.#} and again
server ip {ip:1#.##.1##.2##} is down
in the year #### there were ### people and ## dogs
version #.#.# came out on ##/##/#### with ### changes
the price fell from ##.## to #.## in #### days
at ##:## we saw ## of ### stars
pages ###-### of volume ## tell of ####
it has # ###,### people and ## towns
token = #a##f##b##c##d###e and secret = ab##cd##ef
order ################ was sent on ####-##-##
item ######## weighs ##.# kg and costs ###.##
number ################ stands on the back
see section #.#.#.#.# of the manual
call** of** the** and*** on### it%%% was$$$ ####$$$ then&&& 
THE!! END!! OF!! ####!! DAYS!! WITH!! ##!!
score ##-## after ### minutes in ####
chapter (##) and note [##] say so (see) this [too] (at) last
he (at) home [at] the door (dot) said so
isbn ###-#-##-######-# and code ####-####
room ###, floor #, building ## on street ####
the ratio ###/#### and #e## or #.##e-#
from ####-####-#### parts to ### ### ### units
add ### ### and #### ####
https://example.com/a##/b#?c=## has ### links
""".strip().split("\n")
COPIES = 12

CUES = frozenset("card visa phone tel call fax ring ip mail (at) (dot) [at] [dot]".split())
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]{5,}")


def shape(word: str) -> str:
    """The word with letters as x, digits as d (five or more as their length); cue words stay; an end mark goes."""
    word = word.rstrip(".,;:!?") or word
    low = word.lower()
    if low in CUES:
        return low
    word = _DIGITS.sub(lambda m: f"<{min(len(m.group()), 20)}>", word) if any(c.isdigit() for c in word) else word
    out = _LETTERS.sub("x", word)
    return re.sub(r"[0-9](?![0-9]*>)", "d", out)[:40]


def kind_of(s: str) -> str:
    """A coarser class for shapes that training did not meet."""
    if s in CUES:
        return s
    digits, letters = "d" in s or "<" in s, "x" in s
    marks = "".join(sorted(set(c for c in s if c not in "xd<>0123456789")))[:4]
    return f"{'x' if letters else ''}{'d' if digits else ''}|{marks}"


def labelled_words():
    """(words, labels) of the labelled sentences; label 0 is outside, each kind has one for the first word of a span and one for the others."""
    draw = np.random.default_rng(3)
    for line in LABELLED:
        for _ in range(COPIES):
            line_words, labels = [], []
            for part in re.findall(r"\{[a-z]+:[^}]*\}|[^\s{}]+", line):
                mark = re.match(r"\{([a-z]+):(.*)\}", part)
                label = 2 * KINDS.index(mark[1]) + 1 if mark else 0
                for i, w in enumerate((mark[2] if mark else part).split()):
                    line_words.append("".join(str(draw.integers(10)) if c == "#" else c for c in w))
                    labels.append(label + (mark is not None and i > 0))
            yield line_words, labels


def feature_names(shapes: list[str]) -> list[list[str]]:
    """Per word the features: its shape and class, and those of the words beside it."""
    ends = ["<none>", *shapes, "<none>"]
    coarse = [kind_of(s) for s in ends]
    return [[f"0{ends[i]}", f"0{coarse[i]}|", f"-{coarse[i - 1]}", f"+{coarse[i + 1]}", f"-={ends[i - 1]}", f"+={ends[i + 1]}"] for i in range(1, len(ends) - 1)]


def _sum_exp(x, axis):
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit_field(sentences, steps: int = 150, rate: float = 0.2, ridge: float = 1e-3):
    """(feature names, weights [feature, label], transitions) of most likely labels, by forward-backward and Adam."""
    data = [(feature_names([shape(w) for w in ws]), ls) for ws, ls in sentences]
    names = {n: i for i, n in enumerate(sorted({f for fs, _ in data for x in fs for f in x}))}
    k, length = LABELS, max(len(ls) for _, ls in data)
    b = len(data)
    index = np.full((b, length, 6), len(names))
    gold, mask = np.zeros((b, length), int), np.zeros((b, length), bool)
    for i, (fs, ls) in enumerate(data):
        index[i, :len(ls)] = [[names[f] for f in x] for x in fs]
        gold[i, :len(ls)], mask[i, :len(ls)] = ls, True
    target = np.zeros((len(names) + 1, k))
    np.add.at(target, index[mask], np.eye(k)[gold[mask]][:, None])
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    par = [np.zeros((len(names) + 1, k)), np.zeros((k, k))]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in par]
    for t in range(1, steps + 1):
        weights, trans = par
        emit = weights[index].sum(2) * mask[:, :, None]
        fore, back = np.zeros((b, length, k)), np.zeros((b, length, k))
        fore[:, 0] = emit[:, 0]
        for j in range(1, length):
            step = _sum_exp(fore[:, j - 1, :, None] + trans, 1) + emit[:, j]
            fore[:, j] = np.where(mask[:, j, None], step, fore[:, j - 1])
        for j in range(length - 2, -1, -1):
            step = _sum_exp(trans + (emit[:, j + 1] + back[:, j + 1])[:, None, :], 2)
            back[:, j] = np.where(mask[:, j + 1, None], step, 0)
        total = _sum_exp(fore[:, -1], 1)
        unary = np.exp(fore + back - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(fore[:, :-1, :, None] + trans + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        expected = np.zeros_like(weights)
        np.add.at(expected, index[mask], unary[mask][:, None])
        grads = [(expected - target) / b + ridge * weights, (pair.sum((0, 1)) - moves) / b + ridge * trans]
        for p, g, (m, v) in zip(par, grads, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return list(names), par[0][:-1], par[1]


def viterbi(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of a batch of sequences [batch, place, label], padded at the end."""
    b, length, k = emit.shape
    score, came = emit[:, 0].copy(), np.zeros((b, length, k), np.int8)
    for t in range(1, length):
        reach = score[:, :, None] + trans
        came[:, t] = reach.argmax(1)
        score = np.where((t < lengths)[:, None], reach.max(1) + emit[:, t], score)
    labels = np.zeros((b, length), np.int8)
    at = score.argmax(1)
    for t in range(length - 1, -1, -1):
        live = t < lengths
        labels[live, t] = at[live]
        at = np.where(live & (t > 0), came[np.arange(b), t, at], at)
    return labels


_B = np.arange(256)
PLAIN = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
ENDING = np.isin(_B, [ord(c) for c in ".,;:!?"])
DIGIT = (_B >= 48) & (_B <= 57)
#: Bytes that make a word worth a look; other symbols get a shape only beside one.
TELLING = DIGIT | (_B == ord("@")) | (_B == ord("(")) | (_B == ord("["))


class Field:
    """A trained field with the scores of the shapes met so far."""

    def __init__(self, names, weights, trans):
        self.at = {n: w for n, w in zip(names, weights)}
        self.trans, self.none = trans, np.zeros(trans.shape[0])
        self.ids: dict[str, int] = {}
        self.scores: list[np.ndarray] = []
        self.plain, self.edge = self.shape_id("x"), self.shape_id("<none>")

    def shape_id(self, s: str) -> int:
        """Rows of scores: as the word itself, as the word before another, as the word after another."""
        found = self.ids.get(s)
        if found is None:
            found = self.ids[s] = len(self.scores)
            c = kind_of(s)
            part = lambda *names: sum((self.at.get(n, self.none) for n in names), self.none)
            self.scores.append(np.stack([part(f"0{s}", f"0{c}|"), part(f"-{c}", f"-={s}"), part(f"+{c}", f"+={s}")]))
        return found

    def labels(self, buf, at):
        """(places of the words of all sequences, their labels), with the words of the piece."""
        if len(self.ids) > 200_000:
            self.__init__(list(self.at), list(self.at.values()), self.trans)
        starts, ends, first = words(buf, at)
        if not len(starts):
            return starts, ends, first, np.empty(0, int), np.empty(0, int)
        telling = np.concatenate([[0], np.cumsum(TELLING[buf])])
        near = np.flatnonzero(telling[ends] > telling[starts])
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        step = np.zeros(len(starts) + 1, int)
        np.add.at(step, np.maximum(near - NEAR, first[doc[near]]), 1)
        np.add.at(step, np.minimum(near + NEAR + 1, first[doc[near] + 1]), -1)
        chosen = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        if not len(chosen):
            return starts, ends, first, chosen, chosen
        odd = np.concatenate([[0], np.cumsum(~PLAIN[buf])])
        body = ends[chosen] - ENDING[buf[ends[chosen] - 1]]  # one end mark keeps a word plain
        ids = np.full(len(chosen), self.plain)
        small = body - starts[chosen] <= 4  # plain cue words are short
        for i in np.flatnonzero((odd[body] > odd[starts[chosen]]) | small).tolist():
            ids[i] = self.shape_id(shape(buf[starts[chosen[i]]:ends[chosen[i]]].tobytes().decode()))
        new = np.concatenate([[True], (np.diff(chosen) > 1) | (np.diff(doc[chosen]) > 0)])
        run = np.maximum.accumulate(np.where(new, np.arange(len(chosen)), 0))
        new |= (np.arange(len(chosen)) - run) % LONGEST == 0
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(chosen)))
        table = np.stack(self.scores)
        before, after = np.append(self.edge, ids[:-1]), np.append(ids[1:], self.edge)
        before[new], after[np.append(heads[1:] - 1, len(ids) - 1)] = self.edge, self.edge
        emit = table[ids, 0] + table[before, 1] + table[after, 2]
        out = np.zeros(len(chosen), np.int8)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(np.frexp(lengths[order].astype(float))[1])) + 1
        for group in np.split(order, cuts):  # lengths within a factor of two
            for part in np.array_split(group, -(-len(group) // 4096)):
                grid = np.arange(lengths[part].max())
                place = heads[part][:, None] + np.minimum(grid, lengths[part][:, None] - 1)
                found = viterbi(emit[place], self.trans, lengths[part])
                live = grid < lengths[part][:, None]
                out[place[live]] = found[live]
        return starts, ends, first, chosen, out


STRIP_LEFT, STRIP_RIGHT = "\"'<[{,;:", "\"'>]},;:.!?"


def uncovered(run, base) -> list[list[tuple[int, int]]]:
    """The stretches of words (start, end) of a run that no base span touches; ``base`` has the starts and how far the spans so far reach."""
    starts, reach = base
    out, last = [], -2
    for i, (a, b) in enumerate(run):
        before = bisect_left(starts, b)
        if before and reach[before - 1] > a:
            continue
        out[-1].append((a, b)) if i == last + 1 else out.append([(a, b)])
        last = i
    return out


def field_spans(field: Field, buf, at, base=None):
    """Per document with any: (start, kind, end) in code points of the entities. A begin label, another kind and a
    comma or semicolon before it start a new one. ``base`` gives the base spans of a document, whose words are left out."""
    starts, ends, first, chosen, labels = field.labels(buf, at)
    hot = np.flatnonzero(labels)
    out: dict[int, list] = {}
    if not len(hot):
        return out
    w, kind, begin = chosen[hot], (labels[hot] - 1) // 2, labels[hot] % 2 == 1
    doc = np.searchsorted(first, w, "right") - 1
    ended = np.isin(buf[ends[w] - 1], [ord(","), ord(";")])
    new = np.concatenate([[True], (np.diff(w) > 1) | (np.diff(kind) != 0) | (np.diff(doc) != 0) | begin[1:] | ended[:-1]])
    points = np.concatenate([[0], np.cumsum(buf & 0xC0 != 0x80)])
    own = points[at[:-1]][doc]
    spots = list(zip((points[starts[w]] - own).tolist(), (points[ends[w]] - own).tolist()))
    heads = np.flatnonzero(new)
    known, covers = -1, ((), ())
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(hot)).tolist()):
        d = int(doc[a])
        if d != known:
            spans = base(d) if base else []
            known, covers = d, ([x for x, _, _ in spans], list(accumulate((y for _, _, y in spans), max)))
        text = buf[starts[w[a]]:ends[w[b - 1]]].tobytes().decode()
        for part in uncovered(spots[a:b], covers):
            lo = part[0][0] - spots[a][0]
            piece = text[lo:part[-1][1] - spots[a][0]]
            left = len(piece) - len(piece.lstrip(STRIP_LEFT))
            size = len(piece.strip(STRIP_LEFT).rstrip(STRIP_RIGHT)) if left < len(piece) else 0
            if size > 0:
                out.setdefault(d, []).append((part[0][0] + left, int(kind[a]), part[0][0] + left + size))
    return out


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(model):
    def find(batches):
        import pyarrow as pa

        field = Field(*model)
        for batch in batches:
            for a, b, buf, at in pieces(batch.column("text")):
                found = [base_spans(buf[at[i]:at[i + 1]].tobytes().decode()) for i in range(b - a)]
                added, columns = field_spans(field, buf, at, found.__getitem__), [[] for _ in range(7)]
                for i, base in enumerate(found):
                    more = added.get(i, [])
                    row = [sum(k == j for _, k, _ in base) for j in range(4)]
                    row += [hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)]
                    for column, value in zip(columns, row):
                        column.append(value)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                                 [f.split()[0] for f in SPANS.split(", ")])

    return find


def fit_pii(spark):
    """The model, trained in one task on the labelled table (about 500 sentences)."""
    rows = spark.createDataFrame([(i, ws, ls) for i, (ws, ls) in enumerate(labelled_words())], "id int, words array<string>, labels array<int>")

    def fit(batches):
        import pyarrow as pa

        table = sorted(((i, w, l) for b in batches for i, w, l in zip(*[c.to_pylist() for c in b.columns])))
        names, weights, trans = fit_field([(w, l) for _, w, l in table])
        yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([weights.tobytes()], pa.binary()), pa.array([trans.tobytes()], pa.binary())],
                                         ["names", "weights", "transitions"])

    return cut(rows.repartition(1).mapInArrow(fit, "names array<string>, weights binary, transitions binary"), "pii-model")


def find_pii(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, the numbers of pattern spans per kind, the digest of the pattern spans, all spans, how many were added."""
    row, k = model.first(), LABELS
    parts = (list(row["names"]), np.frombuffer(bytes(row["weights"])).reshape(-1, k), np.frombuffer(bytes(row["transitions"])).reshape(k, k))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(parts), SPANS)
