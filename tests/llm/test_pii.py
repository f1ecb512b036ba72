from oriel.llm import pii

KEY = b"k"


def test_kinds_and_formats():
    text = ("Mail Anna.B@mail.example.org or +1 (568) 555-6437 4918187128635271 now, IP 10.20.30.40 or 2001:db8::ff00:42:8329; SSN 078-05-1120, "
            "IBAN DE89 3704 0044 0532 0130 00. Mrs. Anna Karenina met Mr Smith and Господин Иванов.")
    found = [(text[a:b], k) for a, b, k, _ in pii.find(text)]
    assert found == [("Anna.B@mail.example.org", "email"), ("+1 (568) 555-6437", "phone"), ("4918187128635271", "card"),
                     ("10.20.30.40", "ipv4"), ("2001:db8::ff00:42:8329", "ipv6"), ("078-05-1120", "ssn"), ("DE89 3704 0044 0532 0130 00", "iban"),
                     ("Anna", "name:f"), ("Karenina", "name:s"), ("Smith", "name:s"), ("Иванов", "name:s")]
    for clean in ("On 2024-01-15 we sold 1250 units at 3.75 each, 12.05.2021.", "version 1.2.3 of 17", "a 123456 b", "Dear all,", "Dear Customer, Dear Sir or Madam", "at 12:30:45 a::b", "C++ std::vector ::"):
        assert pii.find(clean) == []


def test_surrogates_keep_type():
    card = pii.surrogate(KEY, "card", "4111111111111111")
    assert len(card) == 16 and card[0] == "4" and pii.luhn(card) and card != "4111111111111111"
    iban = pii.surrogate(KEY, "iban", "DE89370400440532013000")
    assert iban[:2] == "DE" and len(iban) == 22 and pii.iban_rest(iban) == 1
    assert pii.script_of(pii.surrogate(KEY, "name:s", "иванов")) == "cyrillic"
    assert pii.surrogate(KEY, "name:f", "anna")[-1] == "a"
    mail = pii.surrogate(KEY, "email", "anna.b@mail.example.org")
    assert mail.endswith(".org") and mail.count(".") == 3 and mail.index("@") == 6
    assert pii.surrogate(KEY, "phone", "+15685556437").startswith("+1")
    assert pii.surrogate(b"other", "card", "4111111111111111") != card


def test_distinct_and_coherent(spark, docs):
    rows = [(i, f"call +1 (568) 555-{i:04d} or +1.568.555.{i:04d} today, host 10.0.{i}.1") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "nothing here"), (102, "nothing here"), (None, "write to a@b.co twice: A@B.CO")]
    got = pii.pseudonymize(docs(rows), KEY)
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_entities"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[100]["text"] is None and by[101]["text"] == "" and by[102]["text"] == "nothing here"
    seen = set()
    for i in range(40):
        phones = [v for _, _, k, v in pii.find(by[i]["text"]) if k == "phone"]
        assert by[i]["n_entities"] == 3 and f"555-{i:04d}" not in by[i]["text"]
        assert len({p.lstrip("+")[-10:] for p in phones}) <= 2
        seen.add(phones[0])
    assert len(seen) == 40
    twice = by[None]["text"].split()
    assert twice[2].lower() == twice[4].lower() != "a@b.co"


def test_collisions_are_resolved(spark):
    """More entities than the first tries can keep apart: all surrogates differ, none is a real value."""
    ents = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(100)], "kind string, value string")
    got = pii.assign(ents, KEY).collect()
    new = [r["new"] for r in got]
    assert len(new) == len(set(new)) == 100 and not set(new) & {r["value"] for r in got}


def test_empty_table_and_clashing_names(spark, docs):
    assert pii.pseudonymize(docs([]), KEY).count() == 0
    odd = spark.createDataFrame([(1, "ip 1.2.3.4", 9)], "rid long, text string, found long")
    r = pii.pseudonymize(odd, KEY).first()
    assert r["rid"] == 1 and r["found"] == 9 and "1.2.3.4" not in r["text"]


def test_one_surrogate_whatever_the_title(spark, docs):
    said = ["we met Mr. Smith today", "we met Dr. John Smith today", "we met Dr. Smith today", "we met Prof. Smith today", "so Dear Smith we",
            "we met Mr. Alex Smith today", "so Dear Alex Smith we", "we met Dr. Alex today", "we met Miss Kim Jones today",
            "so Dear Kim we", "we met Dr. Jones today", "so Dear John we"]
    got = pii.pseudonymize(docs(list(enumerate(said))), KEY)
    new = {}
    for r in got.collect():
        old = said[r["doc_id"]]
        found = [old[a:b] for a, b, _, _ in pii.find(old)]
        now = [w for w in r["text"].split() if w.rstrip(".") not in old.replace(".", "").split()]
        assert len(found) == len(now) == r["n_entities"]
        for f, w in zip(found, now, strict=True):
            new.setdefault(f, set()).add(w)
    assert {f: len(w) for f, w in new.items()} == {"Smith": 1, "John": 1, "Alex": 1, "Kim": 1, "Jones": 1}
    assert len(set.union(*new.values())) == 5
    assert new["Kim"].pop()[-1] == "a" and new["Alex"].pop()[-1] in "nrsk"


def test_titles_settle_what_a_word_is(spark):
    seen = [("name:n", "smith")] * 5 + [("name:s", "smith")] + [("name:m", "kim")] + [("name:f", "kim")] * 2 + [("name:n", "lee"), ("ssn", "1")]
    got = pii.settle(spark.createDataFrame(seen, "kind string, value string")).collect()
    assert sorted(map(tuple, got)) == [("name:f", "kim"), ("name:n", "lee"), ("name:s", "smith"), ("ssn", "1")]


def test_national_phone_numbers(spark, docs):
    for number in ["030 12345678", "06 12 34 56 78", "06.12.34.56.78", "0049 30 1234567", "00 33 6 12 34 56 78", "0034 912 345 678",
                   "(089) 123 4567", "0171-1234567", "030/1234567", "020 7946 0958", "01632 960001", "02 1234 5678", "0049 (0)30 1234567"]:
        text = f"call {number}, or write"
        assert [(text[a:b], k) for a, b, k, _ in pii.find(text)] == [(number, "phone")], number
    for clean in ["01.02.2024", "01 02 2024", "01-02-2024", "0.5 0.25 0.125", "0.12345678", "00:12:34 05:06:07", "007", "0012", "0123456789", "1,012 345678"]:
        assert pii.find(f"at {clean} we") == [], clean
    rows = [(1, "call 0049 30 1234567 now"), (2, "call +49 30 1234567 now"), (3, "call 030 12345678 now")]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs(rows), KEY).collect()}
    assert got[1][5:9] == "0049" and got[2] == got[1].replace("0049", "+49") and "1234567" not in "".join(got.values())
    assert got[3][5] == "0" != got[3][6] and [len(w) for w in got[3].split()] == [4, 3, 8, 3]


def spans(text):
    return [(text[a:b], k) for a, b, k, _ in pii.find(text)]


def test_names_in_running_text():
    assert spans("Dear Mr. Smith, hi") == [("Smith", "name:s")]
    assert spans("Prof. Dr. Ada Byron spoke") == [("Ada", "name:n"), ("Byron", "name:s")]
    assert spans("Mr. Smith's car met Mr. Smith.") == [("Smith", "name:s")] * 2
    assert spans("Mr. John Smith called. Then John Smith left; Smith’s bag stayed.") == [
        ("John", "name:m"), ("Smith", "name:s"), ("John", "name:m"), ("Smith", "name:s"), ("Smith", "name:s")]
    assert spans("Contact Maria Gonzalez today") == [("Maria", "name:f"), ("Gonzalez", "name:s")]
    assert [w for w, _ in spans("Dr. Smith Yesterday said")] == ["Smith"]
    assert spans("MR. SMITH left") == [("SMITH", "name:s")]
    assert spans("Mme Dupont et Ms. 山田") == [("Dupont", "name:s"), ("山田", "name:s")]
    assert spans("Mr. O'Brien and Mrs. Smith-Jones") == [("O'Brien", "name:s"), ("Smith-Jones", "name:s")]
    for clean in ("Dear Sir or Madam", "Dear Mr", "Maria was here", "the mr smith", "Smithsonian", "Dear Customers, Dear Team"):
        assert spans(clean) == [], clean


def test_mentions_of_a_person_stay_one_person(spark, docs):
    """Brute force: whatever the sentence, each word of a name has one surrogate in all rows, different words different ones."""
    import itertools

    people = [("John", "Smith"), ("Anna", "Kovacs"), ("Paul", "Okafor")]
    forms = ["Dear Mr. {1}, hello", "we saw Dr. {0} {1} and {1}'s dog", "ask {0} {1} now", "PROF. {1} spoke to Mx. {0} {1}", "Mrs. {0} {1} met {0}"]
    rows = [(i, f.format(*p)) for i, (p, f) in enumerate(itertools.product(people, forms))]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs(rows), KEY).collect()}
    new = {}
    for i, old in rows:
        found = pii.find(old)
        at, now = 0, got[i]
        pos = 0
        for a, b, _, word in found:
            keep = old[at:a]
            assert now.startswith(keep, pos)
            pos += len(keep)
            end = pos
            while end < len(now) and now[end].isalpha():
                end += 1
            new.setdefault(word, set()).add(now[pos:end].casefold())
            at, pos = b, end
        assert now[pos:] == old[at:]
    assert all(len(v) == 1 for v in new.values()) and len(set.union(*new.values())) == len(new) == 6


def test_addresses_keep_four_parts():
    assert all(pii.surrogate(KEY, "ipv4", "10.0.0.1", n).count(".") == 3 for n in range(40))


def test_very_long_text():
    text = "plain words here " * 20_000
    assert spans(text + "Mr. Smith " + text + "Smith") == [("Smith", "name:s")] * 2
