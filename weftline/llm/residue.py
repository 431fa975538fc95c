"""Template residue and error pages: positive-unlabelled naive Bayes by expectation-maximization."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import U, bucket, mix, pieces, powers, tokens
from weftline.llm.tokens import has_content
from weftline.session import Scratch

BITS = 18
BUCKETS = 1 << BITS
FIT_DOCS = 40_000  # most documents that the models are fitted on, taken by hash; all documents are scored
EM_ROUNDS = 40  # most rounds; EM ends when no weight and no prior moves by more than EM_STEP
EM_STEP = 0.01
SHRINK, CLIP = 0.015, 5.0  # pseudo-counts as a share of each class, and the bound of a feature's log odds
NOTICE = 1e-3  # share of the passages of real records that may be notices or other boilerplate beside the content
FIT_NOTICE = 1e-12  # the same within EM, where a strong passage may teach more
MAX_LANGS = 15  # languages with a content model of their own; all others share one

# Phrases of trusted records. They only pick the records that the fit starts from; no
# document is judged by them.
TRUSTED_PHRASES = (
    # notices about scripts
    "javascript", "scripts", "scripting", "noscript",
    # errors and missing pages
    "not found", "nicht gefunden", "introuvable", "no encontrada", "não encontrada", "internal server error", "interner fehler", "erreur interne", "error interno", "erro interno",
    "traceback", "uncaught exception", "nullpointerexception", "serviceexception", "\"error\"", "could not connect", "can't find", "something went wrong", "unavailable", "status code", "loading",
    # login and blocking pages
    "access denied", "log in", "anmeldung erforderlich", "human", "session has expired", "rate limit",
    # instructions of a template
    "goes here", "replace this text", "delete this line", "click here to edit", "default text", "todo", "remplacer ce texte", "bitte ersetzen", "sustituya este texto", "substitua este texto", "lorem ipsum",
)
# Common function words; text without one of them is no prose of these languages.
FUNCTION_WORDS = frozenset(
    "the of and in to a is was for with on at by from that are were be as it an or this which had have has not but we our only near between into "
    "der die das und in im den dem des von zu mit auf für ist sind ein eine einer aus bei nach wurde wurden nur am wir "
    "le la les de des du et en un une à au aux pour par sur dans est sont entre nous que plus ont été d l "
    "el los las y del al con por para es son se una su nos más solo como "
    "o os as e do da dos das em no na com um uma ao foi são mais".split()
)
# What may be a slot: anything in the brackets of common template languages, formats and empty values of programs.
_SLOT = re.compile(
    r"\{\{[^{}]{1,1000}\}\}|[$#]\{[^{}]{1,1000}\}|\{%[^%]{1,1000}%\}|\{[^{}]{1,1000}\}|\[\[[^\[\]]{1,1000}\]\]|\[[^\[\]]{1,1000}\]|<<[^<>]{1,1000}>>|<%=?[^%]{1,1000}%>|<[A-Za-z_][^<>=/\"]{0,1000}>"
    r"|&lt;[^&]{1,1000}&gt;|«[^«»]{1,1000}»|\([^()]{1,1000} goes here\)|%\([^()\n]{1,1000}\)[sd]|%%[^%\n]{1,60}%%|@@[^@\n]{1,60}@@|\$[A-Za-z_][A-Za-z_ ]{0,60}\$|\b__[A-Za-z]\w{0,60}?__|\bXX_\w{1,60}?_XX\b"
    r"|\b\w+_PLACEHOLDER\b|%[sd]\b|\b(?:undefined|NaN|null|None|NULL|nil)\b"
)
_MAYBE = re.compile(r"[\[{«@]|<[A-Za-z<%]|&lt;|%[sd(%]|\$[A-Za-z_{]|__|XX_|_PLACEHOLDER|goes here|undefined|NaN|null|None|NULL|nil")
_SIGNS = ("[", "{", "«", "@@", "<", "&lt;", "%", "$", "__", "XX_", "_PLACEHOLDER", "goes here", "undefined", "NaN", "null", "None", "NULL", "nil")  # one of them is in every slot
_EMPTY = re.compile(r"%[sd]|undefined|NaN|null|None|NULL|nil|\[object Object\]")
# Trusted slots, for the fit only: spellings that mean nothing else, outside of quotation marks.
_SURE = re.compile(r"\W*(?:insert|enter|your|rellenar|preencher|à compléter)\b|.*(?:goes here|hier einfügen|to be added|_placeholder)\W*$|\[object object\]$|%%|@@|<%|\{%|<<|&lt;|%\(|XX_", re.I | re.S)
_QUOTED = re.compile(r"(?<!\w)'[^'\n]{1,120}'(?!\w)|\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|‘[^’\n]{1,120}’|`[^`\n]{1,120}`")
_TRUST = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, TRUSTED_PHRASES)) + r")(?!\w)", re.I)
_BREAK = re.compile(r"\n|[.!?]\s")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_INNER = re.compile(r"[^\W\d_]+|[,:;>=|]")
_EDGES = re.compile(r"[^\w\s]*"), re.compile(r"[^\w\s]*$")

@lru_cache(1)
def _function_words() -> np.ndarray:
    """By 24 bits of a word's hash, whether it is a function word."""
    t = np.zeros(1 << 24, bool)
    t[bucket(np.concatenate([tokens([w])[0] for w in sorted(FUNCTION_WORDS)]), 24)] = True
    return t


@dataclass
class Passages:
    """Distinct passages of some texts, in the order of the texts, with their features one behind the other."""

    doc: np.ndarray  # text of each passage
    words: np.ndarray  # words of letters
    plain: np.ndarray  # of them function words
    repeats: np.ndarray  # how often the text has the passage
    size: np.ndarray  # number of features
    f: np.ndarray  # features: words, signs and pairs of them, hashed; and how many function words there are


def passage_features(texts: list[str]) -> Passages:
    """Lines and sentences of the texts, each once a text, so that a long repetitive text cannot outweigh the rest.

    Works on arrays of code points, a bounded piece of text at a time. Case does not matter, words with a digit are one sign.
    """
    parts: list[tuple] = []
    for group, owner in pieces(texts):
        parts.append(_passages(group, owner))
    if not parts:
        none = np.zeros(0, np.int64)
        return Passages(none, none, none, none, none, none.astype(np.int32))
    doc, h, words, plain, size, f = (np.concatenate(x) for x in zip(*parts))
    key = mix(h ^ mix(doc.astype(U) + U(1)))
    _, keep, n = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(keep)
    keep, n = keep[order], n[order]
    used = np.zeros(len(doc), bool)
    used[keep] = True
    return Passages(doc[keep], words[keep], plain[keep], n, size[keep], f[np.repeat(used, size)])


def _passages(texts: list[str], owner: np.ndarray) -> tuple:
    h, pid, text, word = tokens(texts)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none, none, none, none.astype(np.int32)
    new = np.concatenate(([True], (pid[1:] != pid[:-1]) | (text[1:] != text[:-1])))
    p, first = np.cumsum(new) - 1, np.flatnonzero(new)
    n = len(first)
    up, _ = powers()
    whole = mix(np.add.reduceat(h * up[np.arange(len(h)) - first[p]], first))
    same = p[1:] == p[:-1]
    pairs = mix(h[:-1] * U(31) + h[1:] + U(7))[same]
    words, plain = np.bincount(p, word, n).astype(np.int64), np.bincount(p, _function_words()[bucket(h, 24)] & word, n).astype(np.int64)
    long = np.flatnonzero(words >= 8)
    prose = np.where(plain[long] == 0, U(11), np.where(plain[long] * 12 < words[long], U(12), U(13)))
    f = np.concatenate((bucket(h, BITS), bucket(pairs, BITS), bucket(mix(prose), BITS)))
    of = np.concatenate((p, p[:-1][same], long))
    order = np.argsort(of, kind="stable")
    return owner[text[first]], whole, words, plain, np.bincount(of, minlength=n), f[order]


def _hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def _words(s: str) -> list[str]:
    return ["#" if x.isdigit() else x for x in _WORD.findall(_SLOT.sub(lambda m: " ¤ " if _EMPTY.fullmatch(m.group()) else " § ", s).lower())]


def slot_features(text: str) -> list[tuple[bool, list[int]]]:
    """(trusted, features) of every sign of a text that may be a slot, whatever its length, over line breaks too.

    Features are what stands in it and around it in its passage, its spelling, whether it is quoted,
    and how many such signs and empty values the passage has.
    """
    if not any(x in text for x in _SIGNS) or not _MAYBE.search(text):
        return []
    hits = list(_SLOT.finditer(text))
    if not hits:
        return []
    quotes = [m.span() for m in _QUOTED.finditer(text)]
    starts = [a for a, _ in quotes]

    def quoted(m: re.Match) -> bool:
        k = bisect_right(starts, m.start()) - 1
        return k >= 0 and m.end() <= quotes[k][1]

    breaks = [m.end() for m in _BREAK.finditer(text)]
    rows = [(m, bisect_right(breaks, m.start()), quoted(m), bool(_EMPTY.fullmatch(m.group()))) for m in hits]
    empties = Counter(i for _, i, q, e in rows if e and not q)
    signs = Counter(i for _, i, _, _ in rows)
    out = []
    for m, i, q, e in rows:
        g, j = m.group(), bisect_left(breaks, m.end())
        lo, hi = breaks[i - 1] if i else 0, breaks[j] if j < len(breaks) else len(text)
        before, after = _words(text[max(lo, m.start() - 200) : m.start()])[-4:], _words(text[m.end() : min(hi, m.end() + 200)])[:4]
        inner = [] if e else _INNER.findall(g.lower().replace("_", " "))[:8]
        me = "¤" if e else "§"
        run = [*(["^"] if len(before) < 4 else []), *before, me, *after, *(["$"] if len(after) < 4 else [])]
        shape = g.lower() if e else f"{_EDGES[0].match(g).group()[:3]} {_EDGES[1].search(g).group()[-3:]}"
        f = [*(f"in {x}" for x in inner), f"in {min(len(inner), 5)}", *(f"by {x}" for x in before + after), *(f"pair {a} {b}" for a, b in zip(run, run[1:]))]
        f += [f"shape {shape}", f"quoted {q}", f"empties {min(empties[i], 3)} {me}", f"signs {min(signs[i], 3)} {me}"]
        sure = not q and (empties[i] > 1 if e and g != "[object Object]" else bool(_SURE.match(g)))
        out.append((sure, [_hash(x) for x in f]))
    return out


def _is_prose(line: str) -> bool:
    """A line of more than eight words, two or more of them function words, that is no menu."""
    w = re.findall(r"[^\W\d_]+", line.lower())
    return len(w) > 8 and sum(x in FUNCTION_WORDS for x in w) > 1 and not re.search(r"\s[|>]\s", line)


def trusted_records(texts: list[str], ps: Passages) -> np.ndarray:
    """Which texts the fit takes as residue from the start.

    Short ones with a trusted phrase and no prose beside it, one short passage over and over, and repetitive text without any function word.
    """
    n = len(texts)
    words, plain, several = (np.bincount(ps.doc, x, n) for x in (ps.words, ps.plain, ps.repeats))
    out = (np.bincount(ps.doc, minlength=n) == 1) & (several > 2) & (words <= 12)
    for i in np.flatnonzero((words <= 60) & ~out):
        lines = [x for x in re.split(r"\n|(?<=[.!?])\s", texts[i]) if x.strip()]
        told = [bool(_TRUST.search(x)) for x in lines]
        out[i] = any(told) and not any(_is_prose(x) for x, t in zip(lines, told) if not t)
    for i in np.flatnonzero((plain == 0) & (words >= 12) & ~out):
        w = re.findall(r"[^\W\d_]+", texts[i].lower())
        out[i] = len(set(w)) <= 0.8 * len(w)
    return out


@dataclass
class Model:
    """Log odds against the whole collection's frequencies: of residue, of content in each language; and priors."""

    words: np.ndarray | None  # by feature: of residue, then of content in each language
    share: np.ndarray
    prior: float
    slots: np.ndarray | None
    slot_prior: float

    def passages(self, size: np.ndarray, f: np.ndarray, notice: float = NOTICE) -> np.ndarray:
        """Log odds that a residue and not a real record has each passage.

        Residue against content in whatever language explains it; but a real record may carry a
        notice, too, so no passage can speak for residue by more than 1 / ``notice``.
        """
        if not len(size):
            return np.zeros(0)
        z = np.add.reduceat(self.words[f], np.cumsum(size) - size, axis=0).astype(float)  # every passage has a feature
        ways = z[:, 1:] + self.share
        top = ways.max(1)
        return -np.logaddexp(math.log(1 - notice) + top + np.log(np.exp(ways - top[:, None]).sum(1)) - z[:, 0], math.log(notice))

    def slot_odds(self, size: np.ndarray, f: np.ndarray) -> np.ndarray:
        return self.slot_prior + np.bincount(np.repeat(np.arange(len(size)), size), self.slots[f], len(size))


def _log_odds(n: np.ndarray, q: np.ndarray) -> np.ndarray:
    a = max(1.0, SHRINK * n.sum())
    return np.clip(np.log((n + a * q) / ((n.sum() + a) * q)), -CLIP, CLIP)


def _posterior(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(how many numbers each row has, all numbers) of a column of 32-bit numbers as bytes, which Spark moves as they are."""
    wide = pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(ends) // 4, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(np.int32) if data is not None else np.zeros(0, np.int32)


def _bytes(sizes: np.ndarray, numbers: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes) * 4)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(numbers, np.int32).tobytes())])


_UNITS = "lang string, sure boolean, size binary, f binary, slot_sure binary, slot_size binary, slot_f binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            b = whole.slice(lo, 1000)
            texts = b.column(1).to_pylist()
            ps = passage_features(texts)
            n = len(texts)
            slots = [slot_features(t) for t in texts]
            many, found = np.array([len(x) for x in slots], int), [y for x in slots for y in x]
            each = np.array([len(f) for _, f in found], np.int32)
            cols = [
                b.column(0), pa.array(trusted_records(texts, ps)), _bytes(np.bincount(ps.doc, minlength=n), ps.size), _bytes(np.bincount(ps.doc, ps.size, n).astype(int), ps.f),
                _bytes(many, np.array([x for x, _ in found], np.int32)), _bytes(many, each), _bytes(np.bincount(np.repeat(np.arange(n), many), each, n).astype(int), np.array([x for _, f in found for x in f], np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "sure", "size", "f", "slot_sure", "slot_size", "slot_f"])


def _sparse(kind: int, x: np.ndarray) -> pa.RecordBatch:
    i = np.flatnonzero(x)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(x[i].astype(float))], names=["kind", "i", "n"])


def _gather(df: DataFrame, run, kinds: int) -> np.ndarray:
    """Sums by kind and feature over all tasks: at most ``kinds`` x 262,144 numbers come to the driver."""
    rows = df.mapInArrow(run, "kind int, i int, n double").groupBy("kind", "i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((kinds, BUCKETS))
    out[rows["kind"].to_numpy(int), rows["i"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def fit(docs: DataFrame, scratch: Scratch, fit_docs: int = FIT_DOCS, rounds: int = EM_ROUNDS) -> Model:
    """Two positive-unlabelled naive Bayes models by EM: of records through their passages, and of slots.

    ``docs`` has text and lang. Trusted units are residue throughout, all others start as content;
    each round judges them by the model so far and counts them by their posteriors, until nothing
    moves; a model that stands still is left alone. Content has a model for each language (most frequent ones apart, at most 15, and one for
    the rest), so that a language can never pass for residue. Features seen less than three times
    say nothing. Only sums by feature come to the driver, at most 18 x 262,144.
    """
    n = docs.count()
    if n > fit_docs:
        docs = docs.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 12) < int((1 << 52) * fit_docs / n))
    units = scratch.write(docs.select("lang", "text").mapInArrow(_units, _UNITS), "units")
    langs = [r[0] for r in units.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()]
    at, k = {x: i for i, x in enumerate(langs)}, len(langs) + 1
    sc = docs.sparkSession.sparkContext

    def tongues(b: pa.RecordBatch) -> np.ndarray:
        return np.array([at.get(x, k - 1) for x in b.column(0).to_pylist()], int)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 2, BUCKETS))
        for b in batches:
            lang, (per, f) = tongues(b), _numbers(b.column(3))
            own = np.repeat(lang, per)
            for j in np.unique(lang):
                sums[j] += np.bincount(f[own == j], minlength=BUCKETS)
            sums[k] += np.bincount(_numbers(b.column(6))[1], minlength=BUCKETS)
            sums[k + 1, : k + 1] += np.append(np.bincount(lang, minlength=k), len(_numbers(b.column(5))[1]))
        for j, x in enumerate(sums):
            yield _sparse(j, x)

    all_of = _gather(units, totals, k + 2)
    count, slot_count, docs_of, slots_of = all_of[:k], all_of[k], all_of[k + 1, :k].copy(), all_of[k + 1, k]
    words, seen, slot_seen = count.sum(0), count.sum(0) >= 3, slot_count >= 3
    q, slot_q = (words + 1e-3) / (words + 1e-3).sum(), (slot_count + 1e-3) / (slot_count + 1e-3).sum()
    model: Model | None = None
    words_open = slots_open = True
    for _ in range(rounds):
        # a model that stands still is neither sent nor counted any more, nor are its columns read
        known = sc.broadcast((model and Model(model.words if words_open else None, model.share, model.prior, model.slots if slots_open else None, model.slot_prior), words_open, slots_open))
        part = units.select("lang", "sure", *(("size", "f") if words_open else ()), *(("slot_sure", "slot_size", "slot_f") if slots_open else ()))
        part = part if words_open else part.filter("octet_length(slot_f) > 0")

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (m, todo, slots_todo), sums = known.value, np.zeros((k + 2, BUCKETS))
            for b in batches:
                if slots_todo:
                    slot_p, slot_size, slot_f = _numbers(b.column("slot_sure"))[1].astype(float), _numbers(b.column("slot_size"))[1], _numbers(b.column("slot_f"))[1]
                    if m is not None:
                        slot_p = np.maximum(slot_p, _posterior(m.slot_odds(slot_size, slot_f)))
                    sums[k] += np.bincount(slot_f, np.repeat(slot_p, slot_size), BUCKETS)
                    sums[k + 1, k] += slot_p.sum()
                if not todo:
                    continue
                lang, p = tongues(b), b.column("sure").to_numpy(zero_copy_only=False).astype(float)
                per, f = _numbers(b.column("f"))
                if m is not None:
                    many, size = _numbers(b.column("size"))
                    of = np.repeat(np.arange(b.num_rows), many)
                    p = np.maximum(p, _posterior(m.prior + np.bincount(of, m.passages(size, f, FIT_NOTICE), b.num_rows)))
                own, weight = np.repeat(lang, per), np.repeat(p, per)
                some = weight > 1e-9
                for j in np.unique(own[some]):
                    mine = some & (own == j)
                    sums[j] += np.bincount(f[mine], weight[mine], BUCKETS)
                sums[k + 1, :k] += np.bincount(lang, p, k)
            for j, x in enumerate(sums):
                yield _sparse(j, x)

        got = _gather(part, expect, k + 2)
        known.unpersist()
        old = model or Model(np.full((BUCKETS, k + 1), np.inf, np.float32), np.full(k, np.inf), math.inf, np.full(BUCKETS, np.inf), math.inf)
        model = Model(old.words, old.share, old.prior, old.slots, old.slot_prior)
        if words_open:
            pos, docs_pos = got[:k], got[k + 1, :k]
            odds = [_log_odds(pos.sum(0), q), *(_log_odds(np.maximum(count[j] - pos[j], 0), q) for j in range(k))]
            left = np.maximum(docs_of - docs_pos, 0)
            model.words = np.ascontiguousarray(np.where(seen, np.stack(odds), 0).T, dtype=np.float32)
            model.share, model.prior = np.log((left + 1) / (left.sum() + k)), math.log((docs_pos.sum() + 1) / (left.sum() + 1))
            words_open = max(np.abs(model.words - old.words).max(), np.abs(model.share - old.share).max(), abs(model.prior - old.prior)) > EM_STEP
        if slots_open:
            slot_pos, slots_pos = got[k], got[k + 1, k]
            odds = _log_odds(slot_pos, slot_q) - _log_odds(np.maximum(slot_count - slot_pos, 0), slot_q)
            model.slots, model.slot_prior = np.where(slot_seen, np.clip(odds, -CLIP, CLIP), 0), math.log((slots_pos + 1) / (max(0.0, slots_of - slots_pos) + 1))
            slots_open = max(np.abs(model.slots - old.slots).max(), abs(model.slot_prior - old.slot_prior)) > EM_STEP
        if not (words_open or slots_open):
            break
    return model


_SCORES = "residue boolean, record_log_odds double, passage_log_odds double, slot_log_odds double, decided_by string"


def score(texts: list[str], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds of the record, of its best passage, of its best slot) of each text; -99 where it has none.

    The record's are the fitted prior and the sum over its distinct passages.
    """
    n, ps = len(texts), passage_features(texts)
    z = m.passages(ps.size, ps.f)
    record, best, slot = np.where(np.bincount(ps.doc, minlength=n) > 0, m.prior + np.bincount(ps.doc, z, n), -99.0), np.full(n, -99.0), np.full(n, -99.0)
    np.maximum.at(best, ps.doc, z)
    found = [(i, f) for i, t in enumerate(texts) for _, f in slot_features(t)]
    if found:
        doc, fs = zip(*found)
        np.maximum.at(slot, np.array(doc), m.slot_odds(np.array([len(f) for f in fs]), np.concatenate([np.array(f) for f in fs])))
    return record, best, slot


def judge_documents(documents: DataFrame, *, fit_docs: int = FIT_DOCS, rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, residue, the log odds of record, best passage and best slot, and which decided, of every document with content.

    A document is residue if one of its slots is more likely unfilled than not, or the record as a
    whole is more likely residue than content; both by the fitted priors and posteriors. Null and
    blank texts are no cases and have no row. Whole texts are read, whatever their length. The models
    come from a bounded sample of documents; scoring is one pass without a shuffle. ``documents``
    needs doc_id and text; lang is used by the fit if there.
    """
    scratch = Scratch(documents.sparkSession, "p10")
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.select("doc_id", "text", lang.alias("lang")).filter(has_content("text"))
    model = documents.sparkSession.sparkContext.broadcast(fit(docs, scratch, fit_docs, rounds))
    ids = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                record, best, slot = score(part.column(1).to_pylist(), model.value)
                by = np.where(slot > 0, "slot", np.where(record > 0, "passages", None))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((slot > 0) | (record > 0)), pa.array(record), pa.array(best), pa.array(slot), pa.array(by.tolist(), pa.string())], names=["doc_id", "residue", "record_log_odds", "passage_log_odds", "slot_log_odds", "decided_by"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, {_SCORES}")


def residue_found(documents: DataFrame, **kw) -> DataFrame:
    return judge_documents(documents, **kw).filter("residue").select("doc_id")


def clean_documents(documents: DataFrame, **kw) -> DataFrame:
    """The documents without residue, all their columns; null and blank texts are kept."""
    return documents.join(residue_found(documents, **kw), "doc_id", "left_anti")
