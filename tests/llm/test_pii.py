import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hushwin.llm import pii
from hushwin.llm.common import table, words
from tests.conftest import SF01
from tests.llm.cases import edge_docs, empty_docs, rows

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 12 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a9.@-+ 0151(1)x4\nü_%", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + " " * 200_000, "a" * 200_000 + "@", "1 " * 100_000, "4" * 5000 + ".1.1.1"):
        pii.base_spans(text)


def test_training_table_is_learned():
    crf, wrong, total = pii.model(), 0, 0
    for tokens, labels in pii.labelled_sentences():
        at, values = words(pa.array([" ".join(tokens)]))
        coded = values.dictionary_encode()
        got = crf.decode(at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), crf.tables(coded.dictionary))
        wrong, total = wrong + int((got != labels).sum()), total + len(labels)
    assert wrong <= 0.005 * total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Mr.", "Anna", "Schmidt", "the", "token", "=", '"04dbebab91ab85687d33eeaa"', "tel", "555-123-4567", "x.", "A1", "Dr.", "###"]), max_size=6), min_size=1, max_size=4))
def test_viterbi_is_the_best_path(texts):
    crf = pii.model()
    at, values = words(pa.array([" ".join(t) for t in texts]))
    coded = values.dictionary_encode()
    got = crf.decode(at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), crf.tables(coded.dictionary))
    for i, t in enumerate(texts):
        if not t:
            continue
        fs = [[crf.names[f] for f in pii.features(w) if f in crf.names] for w in t]
        e = np.array([crf.own[f].sum(0) for f in fs])
        for j in range(1, len(t)):
            e[j] += crf.before[fs[j - 1]].sum(0)
            e[j - 1] += crf.after[fs[j]].sum(0)
        value = lambda p: sum(e[j, y] for j, y in enumerate(p)) + sum(crf.step[a, b] for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(4), repeat=len(t)))
        assert abs(value(got[at[i]:at[i + 1]].tolist()) - best) < 1e-9


def test_added_spans():
    text = 'Ask Mr. John Miller, or Frau Weber. Tel: 555-123-4567 now; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end. Thion. Ered the.'
    ((base, spans),) = pii.spans_of(pa.array([text]), pii.model())
    assert base == brute(text)
    found = {(k, text[a:b]) for k, a, b in spans}
    assert {("name", "John Miller"), ("name", "Weber"), ("contact", "555-123-4567"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")} <= found
    assert pii.masked(text, spans).startswith("Ask Mr. [NAME], or Frau [NAME]. Tel: [CONTACT] now; token = \"[SECRET]\" end.")


#: Sentences that training does not see, one a line.
HELD_OUT = """
At noon Mr. {name|Walter Finley} left the office with Mrs. {name|Ruth Abel}.
The doctor, Dr. {name|Nora Quist}, asked Ms. {name|Tilda Grant} to sit.
We thank Mr. {name|Osgood} for the flowers.
Heute kommt Frau {name|Petra Lang} mit Herr {name|Ulrich Sommer} zum Essen.
Ich heiße {name|Greta Hahn} und wohne hier.
Nous avons vu Madame {name|Sylvie Caron} et Monsieur {name|Blanchet} au parc.
Je m'appelle {name|Henri Lemaire} depuis toujours.
La señora {name|Elena Campos} y el señor {name|Diego Salas} viajan mucho.
Me llamo {name|Andrea Molina} y soy de aquí.
Please ring Mrs. {name|Vera Dunn}. Phone: {contact|718-204-9931} after lunch.
Call {contact|718-366-0942} for a taxi.
Tel. {contact|0211-884420} oder kommen Sie vorbei.
Fax: {contact|(503) 618-2290} is out of order.
Mobile {contact|07911-204466} or by letter.
phone {contact|503.618.7741} at any time.
Teléfono: {contact|93-418-2207} de lunes a viernes.
The file held token = "{secret|c41e97a05b3d286f97e0d1b4a8c35f2069e7d8b1}" and little else.
api_key = "{secret|pk3a9d1f7c5e2b8460d9f1a3c7e5b2d48}" was in the log.
password: {secret|winter42x} has expired.
export SECRET = "{secret|90ab3fd17c2e48b6a5d0e9c1f7384b62}" is the line.
The bridge over the Danube was closed. In May the Council of Elders met again.
On Tuesday 48 people bought 1,310 tickets for 27.50 each in Lisbon.
Page 48 to page 92 are about the Treaty of Utrecht, Article 7.
Er fuhr mit dem Zug nach Hamburg. Die Reise dauerte 5 Stunden und kostete 48 Euro.
Le Musée du Louvre ouvre à 9 heures. Entrée 17 euros.
La Plaza Mayor de Salamanca tiene 88 arcos. El Museo cierra a las 8.
She keeps no secret and wants no token. The phone is dead, the fax too.
Release 4.0.1 fixes bugs 10432 and 10977. See README and LICENSE.
Green Green Green Green Green Green Green Green Green Green Green Green.
"Stop," said Laura. "Where is Uncle Ben?" Nobody knew.
""".strip()


def test_added_kinds_on_held_out_sentences():
    """Precision and recall of each added kind."""
    assert not set(HELD_OUT.split("\n")) & set(pii.LABELLED.split("\n"))
    seen = {k: [0, 0, 0] for k in pii.ADDED_KINDS}
    for line in HELD_OUT.split("\n"):
        text, want = "", set()
        for part in re.split(r"(\{[a-z]+\|[^}]*\})", line):
            m = re.fullmatch(r"\{([a-z]+)\|([^}]*)\}", part)
            if m:
                want.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        got = {s for s in pii.spans_of(pa.array([text]), pii.model())[0][1] if s[0] in pii.ADDED_KINDS}
        for k, n in seen.items():
            n[0] += sum(s[0] == k for s in want & got)
            n[1] += sum(s[0] == k for s in got)
            n[2] += sum(s[0] == k for s in want)
    for k, (right, found, there) in seen.items():
        print(f"{k}: precision {right / max(found, 1):.2f}, recall {right / there:.2f} of {there}")
        assert right >= 0.9 * found and right >= 0.9 * there


def test_no_labelled_value_occurs_in_the_documents(spark):
    values = set(re.findall(r"\{[a-z]+\|\"?([^}\"]*)\"?\}", pii.LABELLED)) | {w for w in re.findall(r"[0-9][0-9.\-]{6,}[0-9]", pii.LABELLED)}
    text = "\n".join(r.text for r in table(spark, "/root/testdata/sf0.1", "documents").select("text").where("text is not null").toLocalIterator()).lower()
    assert [v for v in values if re.search(rf"(?<!\w){re.escape(v.lower())}(?!\w)", text)] == []


def check(docs):
    got = rows(pii.find(docs))
    texts = docs.select("doc_id", "text").collect()
    digest = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    want = []
    for r in texts:
        base = brute(r.text)
        want.append((str(r.doc_id), *(sum(k == x for k, *_ in base) for x in pii.BASE_KINDS), digest(base)))
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == sorted(want)
    return got


def test_query_equals_patterns(spark):
    got = check(table(spark, SF01, "documents"))
    assert any("secret:" in r["spans"] for r in got)
    assert sum(r["spans"] != "" for r in got) < 0.3 * len(got)


def test_edges(spark):
    check(edge_docs(spark))
    assert rows(pii.find(empty_docs(spark))) == []
    masked = pii.mask_rows(edge_docs(spark))
    assert masked.schema == edge_docs(spark).schema
    assert sorted(map(str, masked.collect())) == sorted(map(str, edge_docs(spark).collect()))
