"""Personal data: fixed patterns plus a linear-chain conditional random field.

The patterns find e-mail and IP addresses, card and phone numbers. The
random field reads word-shape features of each word and its neighbours and
adds names, contact numbers in other notations and secrets; it is trained
on the small labelled table below and decoded by
Viterbi in numpy, many stretches of text at a time.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushwin.llm.common import text_slices, words

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("name", "contact", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
_ORDER = {k: i for i, k in enumerate(KINDS)}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins inside a run of digits, as it would have begun at the run's start: the look-behind only saves steps.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, looked for around each @ only: a match holds one,
    and begins with the local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield "email", m.start(), m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Parts of many digits are compared as text: int() refuses very long ones.
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


#: The labelled table, one sentence a line, written for this purpose; {kind|words} marks a span.
LABELLED = """
Please call Mr. {name|John Miller} about the meeting on Monday.
Mrs. {name|Anna Schmidt} lives in the old house near the river.
Dear Dr. {name|Peter Novak}, thank you for your letter.
Yesterday Ms. {name|Maria Lopez} signed the contract with us.
I met Mr. {name|Robert Brown} and Dr. {name|Alan Reed} in the city.
The report was sent to Mr. {name|Lee} and Mrs. {name|Garcia} last week.
On Friday Mr. {name|Hugh Ellery} told Dr. {name|Joan Pell} that Mrs. {name|Orme} was ill.
A note for Ms. {name|Ida Marsh}: the keys are with Mr. {name|Finch}.
Herr {name|Thomas Becker} hat gestern angerufen.
Frau {name|Julia Weber} wohnt in der Stadt.
Ich heiße {name|Lukas Wagner} und komme aus dem Norden.
Das Buch gehört Frau {name|Weber}. Danach kam Herr {name|Klein}, der Arzt.
Fragen Sie Frau {name|Berg}. Tel: {contact|040-771926} heute.
Gestern hat Herr {name|Jonas Vogt} mit Frau {name|Ilse Kranz} gesprochen.
Contact Mr. {name|Paul Stone}. Phone: {contact|636-014-7788} or write.
We saw Mr. {name|Stone}. Then Mrs. {name|Hill}, or Ms. {name|Park}, came.
Monsieur {name|Pierre Dupont} est parti hier soir.
Madame {name|Claire Martin} habite dans la maison.
Je m'appelle {name|Louis Bernard} et je suis ici.
Hier, Madame {name|Odile Perrin} a vu Monsieur {name|Marchand}, le voisin.
El señor {name|Carlos Ruiz} llegó ayer por la tarde.
La señora {name|Lucia Fernandez} vive en la casa.
Me llamo {name|Pablo Ortega} y trabajo aquí.
Ayer el señor {name|Tomás Vidal} habló con la señora {name|Rosa Prieto}, su vecina.
Call us at {contact|636-812-4567} before noon.
Tel. {contact|030/719326} oder per Post.
Phone: {contact|(314) 772-0187} in the office.
Telefon: {contact|0171-6620914} am Abend.
You can reach him at phone {contact|314.772.0143} every day.
Fax {contact|636-987-6543} and ask for help.
Mobile: {contact|07700-918263} after six.
tel: {contact|01.47.62.12.34} le matin.
Teléfono: {contact|91-662-0918} por la mañana.
The token = {secret|"8d1f04a7c6be93520fd87a41e2b65c309f8e17ad"} was found in the file.
api_key = {secret|"sk9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4"} is set here.
password: {secret|hunter2x9} for the old account.
secret = {secret|"1f6e0b93d2c8475a9e30c7b1d4f8a265"} in the code.
export TOKEN = {secret|"a70b9c2e5d8143f6b09e7d2c4a18f3506be9d7c1"} then run it.
Password: {secret|Tr0ub4dor} and nothing else.
In the text of a page stood token = {secret|"5e82ac1760d94fb3c8a1e7305f6b92d4170c8eab"} among other words.
The log said: a TOKEN = {secret|"D04C71A9E85B3F26907E1CAD6B38F5942D0E7C1B"}!! and went on.
Some notes### token = {secret|"3b90d7e6c15f482a8e07b9d3f64c1a25e0879cdb"}### followed.
The house near the river is old. It was sold in 1998 for 250,000 euros.
The river ran under the bridge. Grey, slow water. Rain fell for the third day.
Der die das und ist nicht. Einen Tag in der Stadt Berlin.
Am Abend ging der Hund durch den Garten. Der Regen fiel auf das Dach und die Straße.
Die Katze schlief. Nur der Wind war zu hören, Tag und Nacht. Ein Haus, Ein Baum.
Le chat est sur la table. Paris est une ville en France.
La pluie tombe. Une lampe brûle encore, Rue de la Gare. Les enfants dorment.
El perro está en la casa. Madrid es una ciudad grande.
La lluvia cae. Las calles de Lima, Quito y Bogotá. Un gato duerme en la silla.
In 2024 there were 1,234 visitors and 56 shops. On Monday we met.
Chapter 12 begins on page 345 and ends on page 367.
It was a Monday in March. The John Deere tractor stood in the field.
Version 1.2.3 came after 1.2.2 and before 2.0.
The price was $4,500.00 in New York and 3.200 in London.
She said: "Come here." Then Peter left. And Anna stayed.
He wrote a token of thanks and a password of sorts.
Zorvan kelim | tarno | welk | ubrim | 5500812347716094 | dolvim.
Kelim 172.16.40.9 zorvan and 6011449207318855 welk the.
Dial +44 (161) 496-0321 or write to june.k@post.example.com today.
Wool### plain%%% grain&&& the*** boots$$$ bread.
The name of the street is long. The call of the wild. A phone rang.
The mobile home and the fax machine are old. Dr. and Mr. are titles.
Zorvan. Kelim the. Tarno at. Ubrim and Welk, und Dolvim und. Der Zorvan und. Kelim.
Zorvan Zorvan Zorvan Zorvan Zorvan Zorvan. Tarno Tarno Tarno Tarno Tarno.
Welk Welk Welk Welk Welk dolvim dolvim Ubrim, Ubrim, Ubrim, Ubrim, Em Em Em.
of Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim Kelim the
tarno. Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk Welk
Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em Em of tarno
Zorvan Kelim Tarno Welk Ubrim Dolvim Zorvan Kelim. Tarno Welk Ubrim Dolvim.
He is. At the end. Is Kelim at. Welk Tarno in the dolvim, of Zorvan. A, I, Em.
Under the GNU General Public License, version 2 of the ISO standard. The MIT License applies.
Licensed under the Apache License, Version 2.0 by the Free Software Foundation.
The Old Man And The Sea. A Tale Of Two Cities. War And Peace And More.
Kelim the at. Zorvan, at Welk. One call. Then Tarno phone. Ubrim reach. Dolvim.
The secret garden is a book. The key is under the mat. No secret. No Password, no Fax, no Tel.
Sr No. 12345678 and item 00123456 were sold. Order 2024-01-15 came late.
Dates: 12.05.2024 and 03/04/2023 and 1999-12-31 at 10:30.
""".strip()

#: Words that count as features of their own; all other words are known by shape.
CUES = frozenset("""mr mrs ms dr herr frau monsieur madame señor señora heiße m'appelle llamo tel phone telefon fax
mobile teléfono token api_key password secret =""".split())
LABELS = ("O",) + ADDED_KINDS
_PLAIN = r"^[\p{Lu}]?[\p{Ll}]+[.,;:!?]?$"
_EDGE = ".,;:!?()\"'"


def shape(word: str) -> str:
    """Upper case X, lower case x, digit 9, runs shortened to one; other characters stay, runs too."""
    out: list[str] = []
    for c in word:
        s = "X" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:12])


def features(word: str) -> tuple[str, ...]:
    """Names of a word's features."""
    core = word.strip(_EDGE)
    cue = core.lower()
    end = "end:" + (word[-1] if word and word[-1] in ".,;:!?" else "")
    if re.fullmatch(r"[^\W\d_]+", core) and len(word) - len(core) <= 1 and not word.startswith(tuple(_EDGE)):
        kind = "X" if core.isupper() and len(core) > 1 else "Xx" if core[0].isupper() else "x"
        return ("shape:" + kind, end) + (("cue:" + cue,) if cue in CUES else ())
    digits = sum(c.isdigit() for c in word)
    out = ["shape:" + shape(core), end, f"digits:{min(digits, 20) if digits < 12 else 12 + (digits > 19)}"]
    if len(core) >= 16 and digits >= 4 and re.search(r"[A-Za-z]", core):
        out.append("long-mixed")
    elif digits and re.search(r"[A-Za-z]", core):
        out.append("mixed")
    if not any(c.isalnum() for c in word):
        out.append("symbols")
    if word.startswith('"') and word.endswith('"'):
        out.append("quoted")
    if cue in CUES:
        out.append("cue:" + cue)
    return tuple(out)


def labelled_sentences() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED.split("\n"):
        tokens, labels = [], []
        for part in re.split(r"(\{[a-z]+\|[^}]*\}[^\x20]*)", line):
            m = re.fullmatch(r"\{([a-z]+)\|([^}]*)\}([^\x20]*)", part)
            for w in ((m[2] + m[3]) if m else part).split():
                tokens.append(w)
                labels.append(LABELS.index(m[1]) if m else 0)
        out.append((tokens, labels))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Crf:
    """Feature weights of the word itself, the one before and the one after, and label transitions."""

    def __init__(self, names: dict[str, int], own, before, after, step):
        self.names, self.own, self.before, self.after, self.step = names, own, before, after, step

    @classmethod
    def train(cls, sentences, rounds: int = 250, ridge: float = 0.02, rate: float = 0.3) -> Crf:
        """Regularised maximum likelihood by forward-backward and Adagrad on all sentences at once, padded."""
        k = len(LABELS)
        names: dict[str, int] = {}
        coded = [[[names.setdefault(f, len(names)) for f in features(w)] for w in tokens] for tokens, _ in sentences]
        m, t = len(sentences), max(len(x) for x in coded)
        x = np.zeros((m, t, len(names)))
        y, real = np.zeros((m, t), int), np.zeros((m, t), bool)
        for i, (row, (_, labels)) in enumerate(zip(coded, sentences)):
            for j, fs in enumerate(row):
                x[i, j, fs] = 1
            y[i, :len(labels)], real[i, :len(row)] = labels, True
        prev, after = np.zeros_like(x), np.zeros_like(x)
        prev[:, 1:], after[:, :-1] = x[:, :-1], x[:, 1:]
        z = np.concatenate((x, prev * real[..., None], after * real[..., None]), 2)
        w, step = np.zeros((z.shape[2], k)), np.zeros((k, k))
        gold = np.eye(k)[y] * real[..., None]
        pairs = real[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]
        sums = [np.full_like(w, 1e-8), np.full_like(step, 1e-8)]
        for _ in range(rounds):
            e = z @ w
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for j in range(1, t):
                grown = _logsum(fwd[:, j - 1, :, None] + step, 1) + e[:, j]
                fwd[:, j] = np.where(real[:, j, None], grown, fwd[:, j - 1])
            for j in range(t - 2, -1, -1):
                back = _logsum(step + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
                bwd[:, j] = np.where(real[:, j + 1, None], back, 0)
            total = _logsum(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - total[:, None, None]) * real[..., None]
            joint = np.exp(fwd[:, :-1, :, None] + step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
            grads = (np.einsum("mtf,mtk->fk", z, gold - p) - ridge * w, (pairs - joint).sum((0, 1)) - ridge * step)
            for value, g, s in zip((w, step), grads, sums):
                s += g * g
                value += rate * g / np.sqrt(s)
        n = len(names)
        return cls(names, w[:n], w[n:2 * n], w[2 * n:], step)

    def tables(self, dictionary: pa.Array) -> list[np.ndarray]:
        """For each distinct word, its weights as the word itself, as the one before and as the one after."""
        n, k = len(dictionary), len(LABELS)
        out = [np.zeros((n, k)) for _ in range(3)]
        if not n:
            return out
        rows: dict[tuple[str, ...], list[int]] = {}
        # Plain words differ in first case and last mark only, so one word stands for each sort.
        plain = pc.match_substring_regex(dictionary, _PLAIN)
        core = pc.utf8_lower(pc.utf8_trim(dictionary, _EDGE))
        plain = pc.and_(plain, pc.invert(pc.is_in(core, value_set=pa.array(sorted(CUES)))))
        plain = plain.to_numpy(zero_copy_only=False)
        upper = pc.match_substring_regex(dictionary, r"^\p{Lu}").to_numpy(zero_copy_only=False)
        last = pc.utf8_slice_codeunits(dictionary, -1).dictionary_encode()
        sort = last.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + upper
        marked = pc.is_in(last.dictionary, value_set=pa.array(list(".,;:!?"))).to_numpy(zero_copy_only=False)
        sort = np.where(marked[sort // 2], sort, sort % 2 - 2)
        for s in np.unique(sort[plain]):
            at = np.flatnonzero(plain & (sort == s))
            rows.setdefault(features(dictionary[int(at[0])].as_py()), []).append(at)
        others = np.flatnonzero(~plain)
        for i, word in zip(others, dictionary.take(pa.array(others)).to_pylist()):
            rows.setdefault(features(word), []).append(np.array([i]))
        for fs, ats in rows.items():
            known, at = [self.names[f] for f in fs if f in self.names], np.concatenate(ats)
            for table, weights in zip(out, (self.own, self.before, self.after)):
                table[at] = weights[known].sum(0)
        return out

    def decode(self, at: np.ndarray, codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The best label of every word; ``at`` are the texts' starts.

        Where O beats every other label by more than transitions could ever
        make up, it is O on the best path, so the text falls into short
        stretches that are decoded on their own, all of a length at once."""
        own, before, after = tables
        labels = np.zeros(len(codes), np.int64)
        if not len(codes):
            return labels
        e = own[codes]
        first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        starts, ends = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
        first[starts], last[ends - 1] = True, True
        e[1:] += np.where(first[1:, None], 0, before[codes[:-1]])
        e[:-1] += np.where(last[:-1, None], 0, after[codes[1:]])
        gain = np.maximum((self.step - self.step[:, :1]).max(0), 0) + np.maximum((self.step - self.step[:1]).max(1), 0)
        open_ = ~((e[:, :1] - e[:, 1:]) > gain[1:]).all(1)
        if not open_.any():
            return labels
        begins = np.flatnonzero(open_ & (first | ~np.concatenate(([False], open_[:-1]))))
        stops = np.flatnonzero(open_ & (last | ~np.concatenate((open_[1:], [False])))) + 1
        size = stops - begins
        for n in np.unique(size):
            for part in np.array_split(begins[size == n], max(1, int((size == n).sum() * n) >> 18)):
                if len(part):
                    labels[part[:, None] + np.arange(n)] = self._viterbi(e[part[:, None] + np.arange(n)], first[part], last[part + n - 1])
        return labels

    def _viterbi(self, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Best paths of stretches (m, n, labels); O stands before and after unless the text begins or ends there."""
        m, n, _ = e.shape
        best = e[:, 0] + np.where(first[:, None], 0, self.step[0])
        back = np.zeros((m, n, e.shape[2]), np.int8)
        for j in range(1, n):
            ways = best[:, :, None] + self.step
            back[:, j] = ways.argmax(1)
            best = ways.max(1) + e[:, j]
        best = best + np.where(last[:, None], 0, self.step[:, 0])
        path = np.zeros((m, n), np.int64)
        path[:, -1] = best.argmax(1)
        for j in range(n - 1, 0, -1):
            path[:, j - 1] = back[np.arange(m), j, path[:, j]]
        return path


@functools.lru_cache(1)
def model() -> Crf:
    return Crf.train(labelled_sentences())


def added_spans(text: str, labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of words with one label, without outer punctuation, that touch no
    base span; a name ends at a mark."""
    where = [m.span() for m in _WORD.finditer(text)]
    out, i = [], 0
    while i < len(labels):
        j = i
        while j < len(labels) and labels[j] == labels[i] and (j == i or labels[i] != 1 or text[where[j - 1][1] - 1] not in ".,;:!?"):
            j += 1
        if labels[i]:
            start, end = where[i][0], where[j - 1][1]
            while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
                start += 1
            while end > start and text[end - 1] in _EDGE:
                end -= 1
            if start < end and not any(a < end and start < b for _, a, b in base):
                out.append((LABELS[labels[i]], start, end))
        i = j
    return out


def spans_of(texts: pa.Array, crf: Crf) -> list[tuple[list, list]]:
    """Per text: (base spans, all spans), each by start, then kind."""
    at, values = words(texts)
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    labels = crf.decode(at, codes, crf.tables(coded.dictionary))
    marked = np.concatenate(([0], np.cumsum(labels > 0)))
    out = []
    for i, text in enumerate(texts.to_pylist()):
        base = base_spans(text or "")
        more = added_spans(text, labels[at[i]:at[i + 1]], base) if marked[at[i + 1]] > marked[at[i]] else []
        out.append((base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]])) if more else base))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and all spans
    (``spans`` as text, ``found`` as structs). Offsets count code points of
    the whole text; null and empty texts have no spans, and repeated rows the
    same ones. No shuffle: a row depends on its text alone."""
    crf = model()

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in text_slices(batches, 1):
            both = spans_of(batch.column(1), crf)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both]),
                 pa.array([_joined(spans) for _, spans in both]), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for _, spans in both], kind)],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or union of overlapping spans, replaced by its kind in brackets."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def mask_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in the text; ``n_chars``, if present, follows it. Rows without spans stay as they are."""
    crf, names = model(), docs.columns
    text_at = names.index("text")

    def run(batches):
        for batch in text_slices(batches, text_at):
            columns = list(batch.columns)
            texts = columns[text_at].to_pylist()
            found = [spans for _, spans in spans_of(columns[text_at].cast(pa.string()), crf)]
            new = [masked(t, s) if s else t for t, s in zip(texts, found)]
            columns[text_at] = pa.array(new, columns[text_at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([len(t) if s else n for t, s, n in zip(new, found, columns[i].to_pylist())], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
