import hashlib
import random
import re
from collections import Counter

import numpy as np
from frames import AWKWARD, documents

from aislelens.llm import personal_data, queries

SF = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def base(text):
    t = text or ""
    spans = [("email", *m.span()) for m in EMAIL.finditer(t)]
    spans += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]
    count = Counter(k for k, _, _ in spans)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return tuple(count[k] for k in personal_data.KINDS), hashlib.sha256(joined.encode()).hexdigest()


def found(rows):
    return Counter((r.doc_id, (r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) for r in rows)


def test_base_of_all_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op3_personal_data(spark, SF).collect()) == Counter((i, *base(t)) for i, t in texts)


def test_base_of_random_strings():
    draw = random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choice("a1234567890....@@-- ()+%é") for _ in range(draw.randrange(60)))
        spans = personal_data.base_spans(text)
        joined = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert hashlib.sha256(joined.encode()).hexdigest() == base(text)[1], text


def test_awkward_rows_and_long_runs(spark):
    more = [(20, "1" * 60_000), (21, "1." * 40_000), (22, "a" * 60_000 + "@"), (23, "+1(" * 20_000), (24, "é a@b.cc 1.2.3.4 999.1.1.1 4111 1111 1111 1111 +1 (678) 555-5272")]
    rows = personal_data.digest(personal_data.scan(documents(spark, AWKWARD + more, clashing=True))).collect()
    short = [r for r in AWKWARD + more if len(r[1] or "") < 1000]
    ours = found(rows)
    assert sum(ours.values()) == len(AWKWARD + more)
    assert all(ours[(r[0], *base(r[1]))] >= 1 for r in short)


def test_added_spans_keep_the_base_and_leave_prose_alone(spark):
    strict = [(i, f"mail someone.{i}@mail{i}.example.com or call +1 (678) 555-52{i:02d} from 10.0.{i}.7") for i in range(60)]
    loose = [(100, "please write e-mail to jane.roe [at] example [dot] com now"), (101, "call our phone (212) 555-0147 today"), (102, "we met at the house in 1999 and at noon")]
    rows = {r.doc_id: r for r in personal_data.digest(personal_data.scan(documents(spark, strict + loose))).collect()}
    assert all(rows[i].spans.count(",") == 2 for i in range(60))
    text = loose[0][1]
    assert rows[100].spans == f"email:{text.index('jane')}:{text.index(' now')}" and rows[100].n_email == 0
    assert rows[101].spans == "phone:15:29"
    assert rows[102].spans == ""


def test_spans_beside_other_digits(spark):
    strict = [(i, f"card 4111 1111 1111 1111 and call +1 (678) 555-52{i:02d} from 10.0.{i}.7") for i in range(60)]
    beside = [
        (100, "call +1 (826) 555-4081 190.137.20.4 now"), (101, "paid 7 4111 1111 1111 1111 today"),
        (102, "5d190bd7c06284de91015a36974748794293dd8a"), (103, "ref 1234 1234 1234 1234 1234 1234"), (104, "x4111 1111 1111 1111 1"),
    ]
    rows = {r.doc_id: r for r in personal_data.digest(personal_data.scan(documents(spark, strict + beside))).collect()}
    assert rows[100].spans == "ip:23:35,phone:5:22" and rows[100].n_phone == 0
    assert rows[101].spans == "card:7:26" and rows[101].n_card == 0
    assert {rows[i].spans for i in (102, 103, 104)} == {""}


def test_reliabilities_tell_good_labelers_from_bad():
    draw = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        true = draw.random() < 0.4
        sign = lambda good: "+" if (draw.random() < good) == true else "-"
        counts[(0, "c" + sign(0.95) + sign(0.9) + sign(0.85) + sign(0.5))] += 1
    patterns = [(k, v, n) for (k, v), n in sorted(counts.items())]
    posterior, table = personal_data.reliabilities(patterns)
    right = table[:, 1, 1]
    assert right[0] > right[1] > right[2] > right[3] + 0.1
    likely = personal_data.classify(patterns)
    assert np.corrcoef(likely, posterior)[0, 1] > 0.95


def test_empty_table(spark):
    assert personal_data.scan(documents(spark, [(1, "a")]).limit(0)).count() == 0
