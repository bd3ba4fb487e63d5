import datetime
import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from spindrift.llm import chat, pii
from spindrift.llm import queries as q


def turns(*convs):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t) for c, texts in convs for i, t in enumerate(texts)]


def test_snapshots_collapse(spark, tmp_path):
    long = [f"t{i}" for i in range(1200)]
    rows = turns((1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["a", "x"]), (5, ["a", "x"]), (6, ["q", None, "r"]), (7, ["q", None]), (8, ["ab"]), (9, long), (10, long[:513]))
    rows += [rows[0], (None, 0, "user", "lost"), (1, None, "user", "lost"), (11, 0, None, "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS strip", "2 AS place").write.parquet(f"{tmp_path}/conversations.parquet")
    out = q.op3_chat(spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.n_turns) for r in out} == {(3, 3), (4, 2), (6, 3), (8, 1), (9, 1200), (11, 1)}
    text = {(r.conv_id, r.part): r.text for r in out}
    assert text[6, 0] == "<|user|>\nq<|end|>\n<|assistant|>\n<|end|>\n<|user|>\nr<|end|>\n"
    assert sorted(p for c, p in text if c == 9) == [0, 1, 2] and text[9, 1].startswith("<|user|>\nt512<")
    assert text[11, 0] == "<||>\nz<|end|>\n"


def test_strips_carry_the_hash(spark, monkeypatch):
    frame = spark.createDataFrame(turns((1, [str(i) for i in range(40)])), "conv_id long, turn long, role string, text string")
    whole = {tuple(r) for r in chat.prefixes(chat.numbered_turns(frame)).collect()}
    monkeypatch.setattr(chat, "STRIP", 7)
    assert {tuple(r) for r in chat.prefixes(chat.numbered_turns(frame)).collect()} == whole


VALID = ["4111 1111 1111 1111", "4465758382889437", "+1 (743) 555-3824", "743-555-3824", "192.168.1.255", "2024-02-29", "31/12/1999", "12/31/1999", "123-45-6789", "DE89370400440532013000"]
VALID += ["GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "Anna.Berg-77@mail.example.org"]
INVALID = ["4485-7583-8288-9437", "256.1.1.1", "2023-02-29", "666-45-6789", "GB82370400440532013000", "1234567890123", "(123) 555-0000"]


def shape(text):
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in text)


def test_pseudonyms_keep_format_and_come_back(spark):
    frame = spark.createDataFrame([(v,) for v in VALID + INVALID], "m string").withColumn("p", pii.pseudonym(F.col("m"), "key")).withColumn("back", pii.pseudonym(F.col("p"), "key", True))
    got = {r.m: r for r in frame.collect()}
    for v in VALID:
        assert got[v].p != v and got[v].back == v
        if "." not in v:
            assert shape(got[v].p)[2:] == shape(v)[2:]
    assert all(got[v].p is None for v in INVALID)
    other = spark.createDataFrame([(v,) for v in VALID], "m string").select(pii.pseudonym(F.col("m"), "other key")).collect()
    assert all(a[0] != got[v].p for a, v in zip(other, VALID, strict=True))


def prf(kind, i, half, size):
    return int(hashlib.sha256(f"{pii.DEMO_KEY}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16) % size


def moved(left, right, a, b, kind):
    for i in range(pii.ROUNDS):
        if i % 2:
            right = (right + prf(kind, i, left, b)) % b
        else:
            left = (left + prf(kind, i, right, a)) % a
    return left, right


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def new_card(text):
    digits = [c for c in text if c.isdigit()]
    n = len(digits) - 1
    u = n // 2
    left, right = moved(int("".join(digits[:u])), int("".join(digits[u:n])), 10**u, 10 ** (n - u), "card")
    body = f"{left:0{u}d}{right:0{n - u}d}"
    out = iter(body + str(-luhn(body + "0") % 10))
    return "".join(next(out) if c.isdigit() else c for c in text)


def in_shape(text, kind):
    """A text permuted within its shape, by the plain rule."""
    shape = re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", text)))
    u = len(text) // 2
    halves = [text[:u], text[u:]]
    for i in range(pii.ROUNDS):
        own, other = halves[i % 2], halves[1 - i % 2]
        digest = "".join(hashlib.sha512(f"{pii.DEMO_KEY}|{kind}:{shape}|{i}|{c}|{other}".encode()).hexdigest() for c in range(len(own) // 16 + 1))
        out = ""
        for at, c in enumerate(own):
            first, size = (48, 10) if c in string.digits else (97, 26) if c in string.ascii_lowercase else (65, 26) if c in string.ascii_uppercase else (None, 0)
            out += c if first is None else chr((ord(c) - first + int(digest[8 * at : 8 * at + 8], 16)) % size + first)
        halves[i % 2] = out
    return "".join(halves)


def new_date(text):
    day = datetime.date.fromisoformat(text) - datetime.date(1700, 1, 1)
    left, right = moved(day.days // 773, day.days % 773, 189, 773, "date")
    return str(datetime.date(1700, 1, 1) + datetime.timedelta(left * 773 + right))


def test_table_against_the_plain_rule(spark, tmp_path):
    """Counts and texts of a table of sentences with values of the kinds whose rule is written out here."""
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(120):
        text, new, n = "", "", [0, 0, 0]
        for _ in range(rng.randint(0, 6)):
            kind = rng.randrange(4)
            if kind == 0:
                body = "".join(rng.choices(string.digits, k=15))
                digits = body + str(-luhn(body + "0") % 10)
                value = rng.choice([digits, " ".join(digits[j : j + 4] for j in range(0, 16, 4))])
                after = new_card(value)
                n[0] += 1
                if rng.random() < 0.3 and " " in value:
                    value, after = value + " 12/27", after + " 12/27"
            elif kind == 1:
                value = str(datetime.date(1700, 1, 1) + datetime.timedelta(rng.randrange(146_097)))
                after = new_date(value)
                n[1] += 1
            elif kind == 2:
                local, domain = "".join(rng.choices(string.ascii_letters + string.digits + "._-", k=rng.randint(1, 40))), rng.choice(["x.org", "mail.example.com"])
                value, after = f"{local}@{domain}", f"{in_shape(local, 'email')}@{domain}"
                n[2] += 1
            else:
                value = after = rng.choice(["plain words", "2023-02-29", "12345", "4111 1111 1111 1112"])
            text, new = f"{text} <{value}>", f"{new} <{after}>"
        rows.append((i, text))
        want[i] = (*n, new)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_card, r.n_date, r.n_email, r.text) for r in q.op2_pii(spark, str(tmp_path)).collect()}
    assert got == want


def test_cards_among_other_digits(spark):
    card = "4111 1111 1111 1111"
    cases = {f"{card} 12/27": 1, "4111111111111111 123": 1, f"7 {card}": 1, f"1234 {card}": 1, f"{card} 5500 0000 0000 0004": 2, f"{card} 743 555 3824": 1, "1 " * 3000: 0}
    rows = list(enumerate(cases))
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _pii", "2 AS `row`", "3 AS n_Card"), "k")
    assert out.columns[:4] == ["doc_id", "text", "_pii", "row"]
    got = {r.doc_id: r for r in out.collect()}
    for i, text in rows:
        assert got[i].n_card == cases[text] and (got[i]._pii, got[i]["row"]) == (1, 2)
        assert (card in got[i].text) == (card in text and not cases[text]) and shape(got[i].text) == shape(text)
    assert got[5].n_phone == 1


def test_permutation_is_one_to_one(spark):
    small = spark.range(15 * 8).select(pii.permute((F.col("id") / 8).cast("long"), F.col("id") % 8, F.lit(15).cast("long"), F.lit(8).cast("long"), "k", "t").alias("x"))
    assert small.distinct().count() == 120
    days = spark.range(146_097).select(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")).alias("d")).select(pii.pseudonym(F.date_format("d", "yyyy-MM-dd"), "k").alias("p"))
    assert days.where("id IS NULL" if False else "p IS NULL").count() == 0
    digits = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d"))
    assert digits.distinct().count() == 1000


def test_documents_keep_what_is_not_personal(spark, tmp_path):
    rows = [(1, "call +1 (743) 555-3824 or a.b@x.example.com, card 4465758382889437."), (2, "card 4465758382889437, again 4465758382889437"), (3, None), (4, ""), (5, "version 1.2.3, 12345, 2023-02-29"), (5, "version 1.2.3, 12345, 2023-02-29"), (None, "10.0.0.1"), (6, "x" * 100_000 + " 10.0.0.1")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pii", "2 AS n_card").write.parquet(f"{tmp_path}/documents.parquet")
    out = q.op2_pii(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert (by[1].n_phone, by[1].n_email, by[1].n_card) == (1, 1, 1) and by[1].text.startswith("call +1 (") and by[1].text.endswith(".")
    card = by[2].text.split()[1].rstrip(",")
    assert by[2].n_card == 2 and by[2].text == f"card {card}, again {card}" and card in by[1].text and card != "4465758382889437"
    assert by[3].text is None and by[4].text == "" and by[5].text == rows[4][1] and by[5].n_date == 0
    assert by[None].n_ip == by[6].n_ip == 1 and by[6].text[:100_001] == "x" * 100_000 + " "
