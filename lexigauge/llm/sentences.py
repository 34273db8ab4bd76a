"""Problem 3: sentence units of texts in any language or script.

A linear-chain model tags the places where a unit could end as boundary or
inside, and Viterbi decoding picks the best sequence; all other characters are
inside, and a line break is always a boundary. What a start and an end look
like is learned from the texts themselves: line breaks are known boundaries, so
lines joined without their breaks are the training data, and the contexts at line
starts and line ends tell a name after "Dr." from the start of a sentence, in Thai
as in English. A second chain reads runs of scripts without spaces that hold no
mark at all: there every character may end a unit, and its training text are the
units of the first chain with their marks stripped.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents (by hash) from which the model is trained, and their code points at most; passes over them, and the step of a correction.
TRAINING_DOCUMENTS, TRAINING_CODE_POINTS, PASSES, STEP = 6000, 8_000_000, 3, 0.02

_LINES = re.compile(r"[^\r\n]+")
_OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "‚": "‘’", "‘": "’"}
_CLOSERS = set("”“»」』）)]》’‘")
_MARKS = ".!?。！？．؟।॥…"
_NO_CASE = "฀-๿぀-ヿ㐀-鿿"
_TOKENS = re.compile(rf"[{_MARKS}]+|[\"'{''.join(_OPENERS)}{''.join(sorted(_CLOSERS - set(_OPENERS))).replace(']', chr(92) + ']')}]|(?<=[{_NO_CASE}])[\s​]+|[\s​]+(?=[{_NO_CASE}»])")
_LIST_ITEM = re.compile(r"\W*(?:[^\W\d_]?\d{1,3}|[A-Za-z])[.)]?\W*")
_CASELESS = re.compile(f"[{_NO_CASE}]")
#: A run in which the second chain looks for ends, in lines without any mark: so many letters on end of a script that has no spaces.
_BARE = re.compile("[぀-ヿ㐀-鿿]{24,}")
_ANY_MARK = re.compile(f"[{_MARKS}]")
_HAN = re.compile("[぀-ヿ㐀-鿿]")
#: Texts that train the second chain, and characters on either side that it sees.
BARE_TEXTS, BARE_CONTEXT = 200, 4
_CONTEXT = 14
#: Times a context must have been seen to tell anything; a shorter one counts else.
EVIDENCE = 12


def content_chars(text: str) -> int:
    """Letters and numbers of ``text``."""
    return sum(map(_letters.__getitem__, text))


def _before(line: str, end: int) -> str:
    """What stands left of a place; "^" is the start of the line."""
    start = max(0, end - 3 * _CONTEXT)
    return (_shape(line[start:end]).lstrip() if start else "^" + _shape(line[:end]).lstrip())[-_CONTEXT:]


_UNSEEN, _DIGITS, _SPACES = re.compile("[​﻿]"), re.compile(r"\d+"), re.compile(r"\s+")


def _shape(text: str) -> str:
    return _SPACES.sub(" ", _DIGITS.sub("0", _UNSEEN.sub("", text))).lower()


class Place:
    """A place in a line where a unit could end, and what the model sees of it."""

    __slots__ = ("end", "known", "left", "right", "signs")

    def __init__(self, end: int, known: bool | None, left: str, right: str, signs: tuple[str, ...]):
        self.end, self.known, self.left, self.right, self.signs = end, known, left, right, signs


def _nesting(line: str, tokens: list[re.Match], ignored: set[int]) -> tuple[dict[int, int], list[int]]:
    """Depth after each bracket or quote by its place, and the openers left open."""
    stack: list[tuple[str, int]] = []
    depth: dict[int, int] = {}
    for m in tokens:
        c, i = m[0], m.start()
        if i in ignored or len(c) > 1 or c in _MARKS or c.isspace() or c == "​":
            continue
        if stack and c in stack[-1][0]:
            stack.pop()
        elif c == '"':
            stack.append(('"', i))
        elif c == "'":
            before, after = line[i - 1 : i], line[i + 1 : i + 2]
            if after.isalpha() and (not before or before.isspace() or before in "([.!?") and re.search(r"[.!?]'", line[i + 1 :]):
                stack.append(("'", i))
        elif c in _OPENERS:
            stack.append((_OPENERS[c], i))
        elif any(c in s for s, _ in stack):
            while c not in stack.pop()[0]:
                pass
        depth[i] = len(stack)
    return depth, [i for _, i in stack]


def places(line: str) -> list[Place]:
    """The places inside one line, from left to right."""
    tokens = list(_TOKENS.finditer(line))
    ignored: set[int] = set()
    while True:
        depth, left_open = _nesting(line, tokens, ignored)
        if not left_open:
            break
        ignored.update(left_open)
    out, now, k = [], 0, 0
    while k < len(tokens):
        m = tokens[k]
        k += 1
        if m[0][0] in _MARKS:
            end, was, closed = m.end(), now, ""
            while k < len(tokens):
                t = tokens[k]
                if t.start() == end and (t[0][0] in _MARKS or depth.get(t.start(), now) < now):
                    pass
                elif t.start() == end and t[0].isspace() and len(t[0]) < 3 and k + 1 < len(tokens) and tokens[k + 1][0] == "»" and tokens[k + 1].start() == t.end():
                    k += 1
                    t = tokens[k]
                else:
                    break
                if t.start() in depth:
                    now = depth[t.start()]
                    closed += t[0]
                end = t.end()
                k += 1
            if now:
                continue
            rest = line[end:]
            after = rest.lstrip()
            if not after:
                continue
            spaced = len(after) < len(rest)
            known = _known(line, m, end, after)
            mark = m[0][-1] if len(set(m[0])) == 1 and len(m[0]) < 2 else ("…" if set(m[0]) <= {".", "…"} else m[0][-1])
            first = next((c for c in after if c.isalnum()), " ")
            kind = "lower" if first.islower() else "upper" if first.isupper() else "digit" if first.isdigit() else "caseless" if first.isalpha() else "none"
            signs = (f"mark={mark}", f"next={kind}", f"mark={mark},next={kind}", f"closed={closed[-1:] != ''},was={was > 0},next={kind}", f"spaced={spaced},mark={mark}", _touching(m, end, after, spaced))
            out.append(Place(end, known, _before(line, end), _shape(after[: 3 * _CONTEXT])[:_CONTEXT], signs))
        elif m.start() in depth and m[0] not in _MARKS:
            now = depth[m.start()]
        elif m[0].isspace() and not now:
            before, after = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
            near = [c for c in (before, after) if c]
            if len(near) == 2 and any(_CASELESS.match(c) for c in near) and before not in _MARKS and not (out and out[-1].end == m.start()):
                if not any(c.isalnum() for c in line[: m.start()]) or _LIST_ITEM.fullmatch(line[: m.start()]):
                    continue
                script = "thai" if any("฀" <= c <= "๿" for c in near) else "han"
                known = False if before in ",;:，；：、" else None
                signs = (f"space={script}", f"space={script},{_class(before)},{_class(after)}")
                out.append(Place(m.start(), known, _before(line, m.start()), _shape(line[m.end() : m.end() + 3 * _CONTEXT])[:_CONTEXT], signs))
    return out


def _class(c: str) -> str:
    return "digit" if c.isdigit() else "caseless" if _CASELESS.match(c) else "letter" if c.isalpha() else "other"


_JUNK = re.compile(rf"[^\w\s]*[{_MARKS}—]+(?:\s|$)")


def _known(line: str, m: re.Match, end: int, after: str) -> bool | None:
    """What is sure without the model: True, False, or None."""
    if not any(map(str.isalnum, line[:end])) or _LIST_ITEM.fullmatch(line[:end]):
        return False
    junk = _JUNK.match(after)
    if junk and not any(map(str.isalnum, junk[0])) and after[0] in _MARKS + "—":
        return True
    return None


def _touching(m: re.Match, end: int, after: str, spaced: bool) -> str:
    """What kind of sign follows a mark at once or after a space, as far as such signs seldom begin a unit."""
    if after[0] in ",;:，；：、-–%/":
        return "after=pause"
    if m[0][-1] in ".?!" and not spaced and end == m.end() and (after[0].islower() or after[0].isdigit() or after[0] in "=_&#@\\"):
        return "after=tight"
    return "after=lower" if after[0].islower() and m[0][-1] in ".?!…" else "after=other"


class _Letters(dict):
    """Whether a character is a letter or number, by character."""

    def __missing__(self, c: str) -> bool:
        found = self[c] = unicodedata.category(c)[0] in "LN"
        return found


_letters = _Letters()


class Chain:
    """Contexts at starts and ends, and the weights of a linear chain over places."""

    def __init__(self):
        self.starts: dict[str, str] = {}
        self.ends: dict[str, str] = {}
        self.weights: dict[str, float] = {}
        self.known: dict[tuple, float] = {}

    def __reduce__(self):
        return _chain, (self.starts, self.ends, self.weights)

    def features(self, p: Place, bins: tuple[str, str]) -> list[str]:
        """Names of what holds at a place; ``bins`` tell how often its contexts stand at boundaries."""
        r, q = bins
        return ["bias", f"R={r}", f"L={q}", f"R={r},L={q}", *([f"R={r},{p.signs[1]}"] if len(p.signs) > 1 else []), *p.signs]

    def emission(self, p: Place) -> float:
        """The score of a boundary at a place."""
        key = _found(self.starts, p.right, False), _found(self.ends, p.left, True), p.signs
        score = self.known.get(key)
        if score is None:
            score = self.known[key] = self.score(self.features(p, key[:2]))
        return score

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def decode(self, emissions: list[float], gaps: list[int], fixed: list[bool | None]) -> list[bool]:
        """Viterbi: the best tags of a line's places, those in ``fixed`` as given."""
        low, back = -1e9, []
        best = (0.0, low)
        short = self.weights.get("B,B,short", 0.0)
        for emit, gap, known in zip(emissions, gaps, fixed):
            inside, boundary = (0.0 if known is not True else low), (emit if known is not False else low)
            after_boundary = best[1] + (short if gap < 4 else 0.0)
            back.append((best[1] > best[0], after_boundary > best[0]))
            best = (max(best) + inside, max(best[0], after_boundary) + boundary)
        tags, state = [], best[1] > best[0]
        for was in reversed(back):
            tags.append(state)
            state = was[state]
        return tags[::-1]

    def tags(self, spots: list[Place]) -> list[bool]:
        """The best tags of the places of one line."""
        ends = [p.end for p in spots]
        return self.decode([self.emission(p) for p in spots], [b - a for a, b in zip([-99, *ends], ends)], [p.known for p in spots])

    def start(self, chains: list[tuple[list[list[str]], list[int], list[bool | None]]]) -> None:
        """Weights to begin with: how much more often a sign stands at known boundaries than at the other places.

        Most of those are boundaries too, so what a boundary has weighs little
        and what it hardly ever has weighs much; the bias lets nine of ten known ones through.
        """
        at, open_ = defaultdict(int), defaultdict(int)
        sure, unsure = [], 0
        for chain, _, known in chains:
            for names, tag in zip(chain, known):
                if tag:
                    sure.append(names)
                for n in names:
                    if "," not in n and n != "bias":
                        (at if tag else open_)[n] += 1
                unsure += not tag
        self.weights = {n: math.log((at[n] + 0.5) / (len(sure) + 1)) - math.log((open_[n] + 0.5) / (unsure + 1)) for n in {*at, *open_}}
        scores = sorted(map(self.score, sure))
        self.weights["bias"] = 0.5 - (scores[len(scores) // 10] if scores else 0.0)

    def fit(self, chains: list[tuple[list[list[str]], list[int], list[bool | None]]]) -> None:
        """Averaged latent perceptron: tags that are not known are the best ones that agree with those known."""
        self.start(chains)
        total: dict[str, float] = defaultdict(float)
        steps = 0
        for _ in range(PASSES):
            for chain, gaps, known in chains:
                steps += 1
                emissions = [self.score(names) for names in chain]
                guess, goal = self.decode(emissions, gaps, [None] * len(chain)), self.decode(emissions, gaps, known)
                if guess == goal:
                    continue
                for sign, tags in ((STEP, goal), (-STEP, guess)):
                    for i, (names, tag) in enumerate(zip(chain, tags)):
                        if tag:
                            extra = ["B,B,short"] if i and tags[i - 1] and gaps[i] < 4 else []
                            for n in (*names, *extra):
                                self.weights[n] = self.weights.get(n, 0.0) + sign
                                total[n] += sign * steps
        if steps:
            self.weights = {n: w - total[n] / (steps + 1) for n, w in self.weights.items()}
        self.known = {}


def _chain(starts: dict[str, str], ends: dict[str, str], weights: dict[str, float]) -> Chain:
    made = Chain()
    made.starts, made.ends, made.weights = starts, ends, weights
    return made


def _add(table: dict[str, list[int]], context: str, which: int, suffix: bool, shortest: int = 1) -> None:
    for n in range(shortest, len(context) + 1):
        table[context[-n:] if suffix else context[:n]][which] += 1


def _bin(at: int, every: int) -> str | None:
    """How often a context stands at a boundary; None where too little is known."""
    if every < EVIDENCE:
        return None
    if at >= 0.012 * every:
        return "rare" if at < 0.06 * every else "some" if at < 0.2 * every else "often"
    return "never" if at + 1 < 0.02 * (every + 2) else None


def _decided(table: dict[str, list[int]]) -> dict[str, str]:
    return {k: b for k, (at, other) in table.items() if (b := _bin(at, at + other))}


def _found(table: dict[str, str], context: str, suffix: bool) -> str:
    """The bin of the longest context of which enough is known."""
    for n in range(len(context), 1 if _CASELESS.search(context) else 2, -1):
        found = table.get(context[-n:] if suffix else context[:n])
        if found:
            return found
    return "unknown"


def _left_out(table: dict[str, list[int]], context: str, suffix: bool) -> str:
    """The same without one boundary's own count."""
    for n in range(len(context), 1 if _CASELESS.search(context) else 2, -1):
        seen = table.get(context[-n:] if suffix else context[:n])
        if seen and (found := _bin(seen[0] - 1, seen[0] + seen[1] - 1)):
            return found
    return "unknown"


def _lines(text: str) -> list[str]:
    return [s for m in _LINES.finditer(text) if any(map(_letters.__getitem__, s := m[0].strip().strip("\ufeff").strip()))]


class Model:
    """The chain over marks and spaces, and the one over the letters of runs without either."""

    def __init__(self):
        self.chain, self.bare = Chain(), Chain()

    def train(self, texts: list[str]) -> None:
        """Learn from texts: lines joined without their breaks, then the units found with their marks stripped."""
        starts, ends = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        split = [_lines(text) for text in texts]
        for line in (line for lines in split for line in lines):
            item = _LIST_ITEM.match(line)
            begin = _shape(line[item.end() :] if item and item[0].strip() and item[0].strip()[-1] in ".)" else line[:60])[:_CONTEXT]
            _add(starts, begin, 0, False)
            _add(ends, _before(line, len(line)), 0, True)
            for p in places(line):
                _add(starts, p.right, 1, False)
                _add(ends, p.left, 1, True)
        self.chain.starts, self.chain.ends = _decided(starts), _decided(ends)
        chains = []
        for lines in split:
            joined, cuts = "", set()
            for line in lines:
                if joined:
                    cuts.add(len(joined))
                    joined += "" if _CASELESS.match(joined[-2:-1]) and joined[-1] in "。！？”」）．" else " "
                joined += line
            spots = places(joined)
            if spots:
                at = [p.end for p in spots]
                bins = [(_left_out(starts, p.right, False), _left_out(ends, p.left, True)) if p.end in cuts else (_found(self.chain.starts, p.right, False), _found(self.chain.ends, p.left, True)) for p in spots]
                chains.append(([self.chain.features(p, b) for p, b in zip(spots, bins)], [b - a for a, b in zip([-99, *at], at)], [True if p.end in cuts else p.known for p in spots]))
        self.chain.fit(chains)
        self._train_bare(texts)

    def _train_bare(self, texts: list[str]) -> None:
        """Units of scripts without spaces, joined without marks, breaks and spaces, tell where units end there."""
        starts, ends = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        chains = []
        for text in [t for t in texts if _HAN.search(t)][:BARE_TEXTS]:
            joined, cuts = "", set()
            for a, b in self.units(text):
                if piece := "".join(c for c in text[a:b] if _HAN.match(c)):
                    joined += piece
                    cuts.add(len(joined))
            for p in bare_places(joined, 0):
                _add(starts, p.right, int(p.end not in cuts), False, 2)
                _add(ends, p.left, int(p.end not in cuts), True, 2)
            chains.append((joined, cuts))
        made = []
        for joined, cuts in chains:
            spots = bare_places(joined, 0)
            bins = [(_left_out(starts, p.right, False), _left_out(ends, p.left, True)) for p in spots]
            gaps = [b - a for a, b in zip([-99, *(p.end for p in spots)], (p.end for p in spots))]
            if spots:
                made.append(([self.bare.features(p, b) for p, b in zip(spots, bins)], gaps, [p.end in cuts for p in spots]))
        self.bare.starts, self.bare.ends = _decided(starts), _decided(ends)
        self.bare.fit(made)

    def units(self, text: str) -> list[tuple[int, int]]:
        """Half-open code-point ranges of the sentence units of ``text``."""
        out = []
        for m in _LINES.finditer(text):
            line = m[0]
            spots = places(line)
            cuts = [p.end for p, t in zip(spots, self.chain.tags(spots)) if t] if spots else []
            if self.bare.weights and (runs := list(_BARE.finditer(line))) and not _ANY_MARK.search(line):
                for run in runs:
                    inner = bare_places(run[0], run.start())
                    cuts += [p.end for p, t in zip(inner, self.bare.tags(inner)) if t]
                cuts.sort()
            start = 0
            for end in [*cuts, len(line)]:
                a, b = start, end
                while a < b and (line[a].isspace() or line[a] == "\ufeff"):
                    a += 1
                while b > a and (line[b - 1].isspace() or line[b - 1] == "\ufeff"):
                    b -= 1
                if any(map(_letters.__getitem__, line[a:b])):
                    out.append((m.start() + a, m.start() + b))
                start = end
        return out


def bare_places(run: str, offset: int) -> list[Place]:
    """The places between the letters of a run without marks or spaces."""
    return [Place(offset + k, None, run[max(0, k - BARE_CONTEXT) : k], run[k : k + BARE_CONTEXT], ()) for k in range(2, len(run) - 1)]


def trained(documents: DataFrame, text: str = "text", limit: int = TRAINING_DOCUMENTS, most: int = TRAINING_CODE_POINTS) -> Model:
    """A model from some ``limit`` distinct texts (twice as many at most), chosen by hash, of ``most`` code points together.

    Texts are taken in the order of their hash; one that no longer fits is passed over.
    """
    texts = documents.select(text).where(F.col(text).isNotNull())
    every = max(1, -(-texts.count() // limit))
    place = F.xxhash64(text)
    sample = texts.where(F.pmod(place, F.lit(every)) == 0).select(F.col(text).alias("text"), place.alias("place"))
    sizes = sample.select("place", F.length("text").alias("n")).distinct().orderBy("place", "n").limit(2 * limit).collect()
    taken, left = set(), most
    for r in sizes:
        if r.n <= left:
            left -= r.n
            taken.add((r.place,))
    wanted = documents.sparkSession.createDataFrame(sorted(taken), "place long")
    model = Model()
    model.train([r.text for r in sorted(sample.join(F.broadcast(wanted), "place", "left_semi").distinct().collect(), key=lambda r: (r.place, r.text))])
    return model


def sentence_units(documents: DataFrame, document_id: str = "document_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``(document_id, start_cp, end_cp, content_chars)`` of every sentence unit of every distinct document.

    Null, empty and letterless texts have no units. Repeated rows count once;
    rows of one id with other texts each give their units. Null ids are kept.
    A table without texts gives no rows. Other columns are not read. Without
    ``model`` one is trained from a bounded sample of the same documents; all
    documents are then tagged whole.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(document_id).alias("document_id"), F.col(text).alias("text")).where("text is not null")
    sent = spark.sparkContext.broadcast(model or trained(rows))
    kind = rows.schema["document_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for frame in frames:
            found = [(d, a, b, content_chars(t[a:b])) for d, t in zip(frame["document_id"], frame["text"]) for a, b in own.units(t)]
            yield pd.DataFrame(found, columns=["document_id", "start_cp", "end_cp", "content_chars"])

    return rows.dropDuplicates().mapInPandas(run, f"document_id {kind}, start_cp long, end_cp long, content_chars long")
