import re

from gradus.llm import pii

KEY = b"test key"
TEXT = ("call +1 (999) 555-2485 or 212-555-1234, mail Bosbt.42@mail8.example.com; card 4041 8949 7460 8795 ip 70.123.182.155 "
        "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 on 2021-03-04 or 12/31/1999, +49 30 1234567.")


def test_feistel_is_a_permutation_with_inverse():
    for n in (1, 2, 7, 100, 997):
        out = [pii.feistel(i, n, KEY, "t") for i in range(n)]
        assert sorted(out) == list(range(n)) and [pii.feistel(x, n, KEY, "t", True) for x in out] == list(range(n))
    assert [pii.feistel(i, 997, KEY, "t") for i in range(5)] != [pii.feistel(i, 997, b"other", "t") for i in range(5)]


def test_formats_stay_and_values_go():
    new, n = pii.pseudonymise(TEXT, KEY)
    assert n == {"phone": 3, "email": 1, "card": 1, "ip": 1, "ssn": 1, "iban": 2, "date": 2}

    def shape(s):
        return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", re.sub(r"ip \S+", "", s))))

    assert shape(new) == shape(TEXT)
    for old in ("555-2485", "555-1234", "Bosbt.42@", "4041 8949 7460 8795", "70.123.182.155", "123-45-6789", "0532 0130", "2021-03-04", "12/31/1999", "1234567."):
        assert old not in new
    card = re.search(r"card ([0-9 ]{19})", new)[1]
    assert pii.luhn(pii.digits_of(card)) == 0 and card[0] == "4"
    iban = re.search(r"iban (DE[0-9 ]{25})", new)[1].replace(" ", "")
    assert pii.iban_rest(iban) == 1
    assert pii.pseudonymise(new, KEY, back=True)[0] == TEXT


def test_equal_values_stay_linked_and_others_apart():
    a = pii.pseudonymise("born 2001-02-03 as 4041894974608795", KEY)[0]
    b = pii.pseudonymise("03.02.2001 and 4041-8949-7460-8795", KEY)[0]
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", a).groups()
    assert f"{d}.{m}.{y}" in b and pii.digits_of(a)[-16:] == pii.digits_of(b)[-16:]
    many = {pii.pseudonymise(f"10.0.{i}.{j}", KEY)[0] for i in range(20) for j in range(20)}
    assert len(many) == 400


def test_invalid_numbers_stay():
    for s in ("4041894974608796", "000-12-3456", "666-12-3456", "123-00-4567", "300.1.1.1", "2021-02-30", "13/32/1999", "DE88 3704 0044 0532 0130 00", "v1.2.3", "3.14159", "1234"):
        assert pii.pseudonymise(s, KEY) == (s, {})


def test_table_with_odd_rows(spark, make, odd_rows):
    rows = [r + ("x",) for r in odd_rows + [(20, TEXT, "en", "s", 1)]]
    docs = make(rows, ", n_card string")
    out = pii.pseudonymise_documents(docs, KEY)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "text", *[f"n_{k}" for k in pii.KINDS]}
    got = out.collect()
    assert len(got) == len(rows)
    want = [(str(r[0]), None if r[1] is None else pii.pseudonymise(r[1], KEY)[0]) for r in rows]
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.n_card for r in got) == 1
    assert pii.pseudonymise_documents(make([]), KEY).count() == 0


def test_values_beside_other_numbers():
    card, again = "4111111111111111", pii.pseudonymise("4111111111111111", KEY)[0]
    spaced = "4111 1111 1111 1111"
    phone, iban = pii.pseudonymise("412-555-0199", KEY)[0], pii.pseudonymise("AT61 1904 3002 3457 3201", KEY)[0]
    two = pii.pseudonymise("2223003122003222", KEY)[0]
    assert again != card and pii.luhn(again) == 0 and 2221 <= int(two[:4]) <= 2720 and pii.luhn(two) == 0 and two != "2223003122003222"
    refilled = pii.refill(spaced, again)
    for before, after, kind in ((f"{card} 12/27", f"{again} 12/27", "card"), (f"{card} 123", f"{again} 123", "card"), (f"{spaced} 123", f"{refilled} 123", "card"),
                                (f"{spaced} 12/27 123", f"{refilled} 12/27 123", "card"), (f"{card}-2027", f"{again}-2027", "card"), (f"2024 {card}", f"2024 {again}", "card"), (f"345 {card}", f"345 {again}", "card"),
                                ("2223003122003222 12/27", f"{two} 12/27", "card"), ("412-555-0199 2024", f"{phone} 2024", "phone"), ("AT61 1904 3002 3457 3201 BIC", f"{iban} BIC", "iban"),
                                ("AT61 1904 3002 3457 3201 BKAUATWW", f"{iban} BKAUATWW", "iban"), ("DE88 3704 412-555-0199", f"DE88 3704 {phone}", "phone")):
        assert pii.pseudonymise(before, KEY) == (after, {kind: 1})
        assert pii.pseudonymise(after, KEY, back=True)[0] == before
    for iban in ("ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "SE45 5000 0000 0583 9825 7466"):
        new, n = pii.pseudonymise(f"{iban} BIC", KEY)
        assert n == {"iban": 1} and new == pii.pseudonymise(iban, KEY)[0] + " BIC" and pii.pseudonymise(new, KEY, back=True)[0] == f"{iban} BIC"
    assert pii.pseudonymise("2111111111111111 and 2820000000000000", KEY)[1] == {}


def test_long_cards_and_numbers_behind_come_back(rng):
    for _ in range(300):
        body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
        card = body + str(-pii.luhn(body + "0") % 10)
        g = " ".join(card[i:i + 4] for i in range(0, 16, 4))
        long = card[:15] + rng.choice("0123456789") + "00"
        long += str(-pii.luhn(long + "0") % 10)
        for t in (f"{card} {rng.randint(100, 999)}", f"{g} {rng.randint(100, 999)}", f"{g} 12/27", long, " ".join(long[i:i + 4] for i in range(0, 19, 4))):
            new, n = pii.pseudonymise(t, KEY)
            assert n == {"card": 1} and pii.pseudonymise(new, KEY, back=True)[0] == t
        assert pii.pseudonymise(f"{g} 123", KEY)[0][:19] == pii.refill(g, pii.pseudonymise(card, KEY)[0])
