import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from voxtab.llm import pii

FIXED = [
    "é a@b.c%d@e.f x@y z@-.- 😀 .a@b..c a@b.c. 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3 99999999999.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111111111111112 4111  1111 1111 1111 1 2",
    "4111 1111 1111 1111 2 41111111111111111111 5 6011000990139424- 6011000990139424",
    "+1 (415) 555-2671. +12 +123456789012345 +1234567890123456 +1 ((((..)- +49 30 1234567x +4 (0)20) 7946 0958",
    "a" * 70 + "@x.y " + "%" * 50 + " @ \x01 1.1.1.1\x02 mid@dle.com\x01", "\x01 +1 415 555 2671 \x01", "",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 16 <= len(digits) <= 19 and luhn(digits) else []
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def contexts(text, matches):
    """The patterns around matches of one search, whose gaps end at the matches before and after."""
    out = {}
    for k, (a, b) in enumerate(matches):
        left = text[matches[k - 1][1] if k else 0:a][-48:]
        right = text[b:matches[k + 1][0] if k + 1 < len(matches) else len(text)][:48]
        lw, rw = words(left), words(right)
        pats = {f"{lw[-2]} {lw[-1]} _"} if len(lw) > 1 else set()
        pats |= {f"{lw[-1]} _ {rw[0]}"} if lw and rw else set()
        sign = re.search(r"""([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)[ \t\n\r\f\v]*[:=#][ \t\n\r\f\v]*["']?$""",
                         re.sub("[A-Z]", lambda m: m[0].lower(), left))
        out[a, b] = pats | ({f"{sign[1]}: _"} if sign else set())
    return out


def plain(rows, rounds=pii.ROUNDS):
    searches = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    spans, asked, kinds, met = [], [], {}, defaultdict(set)
    for n, (_, text) in enumerate(rows):
        text = text or ""
        found = base(text)
        for kind in pii.KINDS:
            if kind == "card":
                every = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                         if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
            else:
                every = [m.span() for m in re.finditer(searches[kind], text)]
            for (a, b), pats in contexts(text, every).items():
                if (kind, a, b) in found:
                    spans.append((n, pii.KINDS.index(kind), a, b))
                    value = text[a:b].lower()
                    kinds[value] = min(kinds.get(value, 9), pii.KINDS.index(kind))
                    for p in pats:
                        met[p].add(value)
        cands = [m.span() for m in re.finditer(pii.CANDIDATE.replace("20}+", "20}"), text)]
        for (a, b), pats in contexts(text, cands).items():
            if not any(a < e and s < b for _, s, e in found):
                asked.append((n, a, b, pats))
                for p in pats:
                    met[p].add(text[a:b].lower())
    met = {p: v for p, v in met.items() if len(v) >= pii.SUPPORT}

    def score(belief):
        best = {}
        for p, values in met.items():
            for k in range(pii.N_BASE):
                votes = [1000 if kinds.get(v) == k else belief[v][1] for v in values
                         if kinds.get(v) == k or v not in kinds and v in belief and belief[v][0] == k]
                if len(votes) >= pii.SUPPORT and sum(votes) // len(values) >= pii.CONFIDENCE:
                    best[p] = (k, sum(votes) // len(values))
        return best

    best = score({})
    for _ in range(rounds):
        doubt = defaultdict(lambda: [0] * pii.N_BASE)
        for p, (k, c) in best.items():
            for v in met[p]:
                if v not in kinds:
                    doubt[v][k] += math.floor(-1e6 * math.log(1 - min(c, 999) / 1000))
        if not doubt:
            break
        best = score({v: (d.index(max(d)), math.floor(1000 * (1 - math.exp(-max(d) / 1e6)))) for v, d in doubt.items()})
    for n, a, b, pats in asked:
        hits = [(-best[p][1], best[p][0]) for p in pats if p in best]
        if hits:
            spans.append((n, pii.N_BASE + min(hits)[1], a, b))
    by_row = defaultdict(list)
    for n, *s in spans:
        by_row[n].append(tuple(s))
    out = []
    for n, (i, _) in enumerate(rows):
        mine = sorted(by_row[n])
        join = lambda some: ",".join(f"{pii.NAMES[k]}:{a}:{b}" for k, a, b in some)
        own = [s for s in mine if s[0] < pii.N_BASE]
        out.append((i, *[sum(s[0] == k for s in own) for k in range(pii.N_BASE)],
                    hashlib.sha256(join(own).encode()).hexdigest(), join(mine)))
    return Counter(out)


def frame(spark, rows):
    extra = [(*r, 1, "s", 2, 3) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, _row int, id string, kind int, parts int").repartition(4)


def test_base_kinds_equal_a_plain_search(spark, cases, empty):
    r = random.Random(5)
    pieces = ["a", "1", "22", ".", "@", "-", " ", "+", "(", "255", "300", "%", "x.y", "é", "4111 1111 1111 1111", "+1 ", "\n"]
    made = [(k, "".join(r.choices(pieces, k=r.randint(1, 60)))) for k in range(400)]
    rows = [*cases, *enumerate(FIXED), *made]
    out = pii.pii_summary(frame(spark, rows)).collect()
    assert Counter(tuple(x) for x in out) == plain(rows)
    listed = {x.id: x.spans for x in out if x.id in range(len(FIXED))}
    assert len(listed) == len(FIXED) and sum(x.n_card for x in out) > 3
    assert pii.pii_summary(empty).count() == 0


@pytest.mark.parametrize("copies", [1, 3])
def test_contexts_find_further_identifiers(spark, copies):
    r = random.Random(copies)
    rows = []
    for k in range(30):
        phone = f"+1 (415) 555-{1000 + k}" if k < 28 else f"555-{1000 + k}"
        rows.append((k, f"Some words, then please call {phone} today or tomorrow."))
        mail = f"name{k}@mail.example.com" if k % 6 else f"name{1000 + k}#mail.example"
        rows.append((100 + k, f"Mail: {mail} and so on"))
        rows.append((200 + k, f"order {r.randrange(10**8)} was of {r.randrange(10**8)} was"))
    rows += [(300 + k, f"or ring us {v} at once, or please call {v} today") for k, v in enumerate(
        ["555-7001", "555-7002", "555-7003"])]
    rows += [(310 + k, f"or ring us {555000 + k}-1 at once") for k in range(3)]
    out = pii.pii_summary(frame(spark, rows * copies)).collect()
    assert Counter(tuple(x) for x in out) == plain(rows * copies)
    spans = {x.id: x.spans for x in out}
    assert spans[28] == "context_phone:29:37" and spans[100] == "context_email:6:27"
    assert spans[200] == "" and "context_phone" in spans[300]


def test_long_texts(spark):
    rows = [(1, "9" * 3_000_000 + " a@b.co"), (2, "1 " * 500_000), (3, "x" * 2_000_000 + "@y.z"), (4, "+" + "(" * 100_000)]
    out = {x.id: x.spans for x in pii.pii_summary(frame(spark, rows)).collect()}
    assert out == {1: "email:3000001:3000007", 2: "", 3: "email:0:2000004", 4: ""}


def test_no_python_on_the_way(spark, docs):
    text = pii.pii_summary(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
