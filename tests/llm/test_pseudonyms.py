import datetime
import random
import string
import time

from pyspark.sql import functions as F

from mvtrack.llm import pseudonyms as P

KEY = b"k"


def test_permutations_are_bijections():
    for size in (1, 2, 3, 7, 10, 97, 1000):
        got = [P.permute(KEY, "t", size, x) for x in range(size)]
        assert sorted(got) == list(range(size))
        assert [P.permute(KEY, "t", size, y, True) for y in got] == list(range(size))
    assert P.permute(KEY, "t", 10**15, 5) != P.permute(b"other", "t", 10**15, 5)


def test_formats_stay_valid_and_go_back():
    text = "card 4539578763621486 or 4539-5787-6362-1486, ip 97.51.17.173, ssn 123-45-6789, born 1980-02-29, 31/12/1999 and 12/31/1999, +1 (555) 010-2345, DE89 3704 0044 0532 0130 00, mail jörg.9@mail7.example.com."
    new, spans = P.replace(text, KEY)
    assert [k for k, _, _ in spans] == ["card", "card", "ip", "ssn", "date", "date", "date", "phone", "iban", "email"]
    assert abs(len(new) - len(text)) <= 8  # the address in dots
    old = [text[a:b] for _, a, b in spans]
    assert not any(o in new for o in old)
    assert P.replace(new, KEY, back=True)[0] == text
    _, again = P.replace(new, KEY)
    assert [k for k, _, _ in again] == [k for k, _, _ in spans]  # the pseudonyms are valid themselves
    a, b = (new[again[i][1] : again[i][2]] for i in (0, 1))
    assert a == b.replace("-", "")  # equal values stay equal
    datetime.date.fromisoformat(new[again[4][1] : again[4][2]])


def test_clean_texts_are_left_alone():
    for text in ("4539578763621487 fails its check", "999.1.2.3 and 1.2.3.4.5", "2021-02-30", "version 1.2.3", "000-12-3456", "page 1234567", "DE89 3702 0044 0532 0130 00", "a@b", "call 911", "4d15ec8f90433955bf9d3cf61da5bdd1e", ""):
        assert P.replace(text, KEY) == (text, []), text


def test_documents(spark, make_docs):
    docs = make_docs(["ip 10.0.0.1 here", "and 10.0.0.1 there", None, "", "clean", "ip 10.0.0.1 here"], [1, 2, 3, None, 5, 1]).withColumn("spans", F.lit("x"))
    rows = P.mask_documents(docs, KEY).collect()
    got = {(r.doc_id, r.n_replaced, r.text is None) for r in rows}
    assert len(rows) == 6 and got == {(1, 1, False), (2, 1, False), (3, 0, True), (None, 0, False), (5, 0, False)}
    ip = {r.text.split()[1] for r in rows if r.n_replaced}
    assert len(ip) == 1
    assert P.mask_documents(docs.limit(0), KEY).count() == 0


def test_very_long_text_and_many_values():
    text = "x " * 200_000 + "10.0.0.1 " * 500
    new, spans = P.replace(text, KEY)
    assert len(spans) == 500 and "10.0.0.1 " not in new


def test_least_digits_of_each_format():
    body, number = "ABCDEFGHIJKL", lambda t: int("".join(str(int(c, 36)) for c in t))
    letters = f"XY{98 - number(body + 'XY00') % 97:02d}{body}"  # valid, with two digits
    for kind, value in (("date", "1/2/2020"), ("date", "5-6-1999"), ("date", "2020-1-5"), ("ip", "1.2.3.4"), ("phone", "(55) 555-0123"), ("iban", letters)):
        new, spans = P.replace(f"on {value} only", KEY)
        assert [k for k, _, _ in spans] == [kind] and value not in new, value
    clear, more = P.replace("on 1/2/2020", KEY)[0], P.replace("on 1/2/2020, page 7", KEY)[0]
    assert more == clear + ", page 7"  # whatever else the text holds


def test_cheap_exit_loses_nothing():
    import random

    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789AZ./- ()+") for _ in range(rng.randrange(6, 14)))
        assert P.replace(text, KEY)[1] == [(k, a, b) for k, a, b in P.replace(text + " @", KEY)[1] if b <= len(text)], text


def test_no_value_stays_as_it_is():
    for size in (2, 3, 26, 97):
        got = [P.derange(KEY, "t", size, x) for x in range(size)]
        assert sorted(got) == list(range(size)) and all(x != y for x, y in enumerate(got))
        assert [P.derange(KEY, "t", size, y, True) for y in got] == list(range(size))
    for letter in "abcdefghijklmnopqrstuvwxyz":
        new, spans = P.replace(f"{letter}@x.com", KEY)
        assert len(spans) == 1 and new != f"{letter}@x.com" and new.endswith("@x.com")


def test_addresses_of_any_script():
    for mail in ("иван@mail.ru", "田中@example.jp", "jörg.Müller-9@x.de", "αβγ@y.gr", "عمر@z.sa", "김철수@k.kr"):
        text = f"to {mail} please"
        new, spans = P.replace(text, KEY)
        assert [k for k, _, _ in spans] == ["email"] and mail not in new and len(new) == len(text)
        assert all(a == b or not a.isalnum() or P._alphabet(a) == P._alphabet(b) for a, b in zip(text, new, strict=True))
        assert P.replace(new, KEY, back=True)[0] == text
    assert P.replace("to _@x.com", KEY) == ("to _@x.com", [])  # nothing to replace, nothing counted


def test_widths_and_country_codes_stay():
    for text in ("5/6/1999", "15/6/1999", "05.06.1999", "2020-1-5", "12/31/1999", "+49 30 1234567", "+4930123456789", "+1 (555) 010-2345", "555-234-6789", "123-456-7890"):
        new, spans = P.replace(text, KEY)
        assert len(spans) == 1 and len(new) == len(text) and new != text
        assert [c.isdigit() for c in new] == [c.isdigit() for c in text]
        assert P.replace(new, KEY, back=True)[0] == text
        if text[0] == "+":
            assert new[:3] == text[:3]
    assert P.replace("555-234-6789", KEY)[0][0] >= "2"


def test_time_grows_with_the_findings():
    import time

    def took(n):
        text = " ".join(f"user{n}x{k}@host.example" for k in range(n))
        began = time.process_time()
        assert len(P.replace(text, KEY)[1]) == n
        return time.process_time() - began

    took(100)
    assert took(20_000) < 12 * max(took(4_000), 0.05)


def test_very_long_mail_names(spark, make_docs):
    """One to one, of the same shape, in linear time, and through Spark."""
    rng = random.Random(3)
    names = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (64, 65, 3050, 4000, 100_000)]
    names += [names[4][:-1] + c for c in "xyz"] + ["".join(rng.choice("абвгд") for _ in range(5000))]
    times, made = [], []
    for name in names:
        began = time.time()
        new, spans = P.replace(f"to {name}@x.com now", KEY)
        times.append(time.time() - began)
        made.append(new)
        assert P.replace(new, KEY, back=True)[0] == f"to {name}@x.com now"
        assert [k for k, _, _ in spans] == ["email"] and len(new) == len(name) + 13 and new.endswith("@x.com now")
        assert all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(new[3:], name, strict=False)) and new[3 : 3 + len(name)] != name
    assert len(set(made)) == len(set(names)) and times[4] < 8
    got = P.mask_documents(make_docs([f"{names[4]}@x.com", "a@b.co"]), KEY).orderBy("doc_id").collect()
    assert got[0].text == made[4][3:-4] and got[1].n_replaced == 1
