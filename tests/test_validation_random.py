"""Random requests (Unicode blanks, multi-byte text, odd channels) through the Spark
validation and through a direct Python statement of the same rules."""

import random
import re

from missive.operators import validate as V

WS = "\t\n\x0b\x0c\r \x85\xa0        　"
PHONE = re.compile(r"\+?[1-9][0-9]{7,14}")


def py_trim(s):
    return s.strip(WS + "".join(chr(c) for c in range(0x2000, 0x200B)))


def py_first_error(key, rcp, ch, content, pr):
    key, rcp, content = py_trim(key), py_trim(rcp), py_trim(content)
    ch, pr = py_trim(ch).lower(), py_trim(pr).lower()
    n = len(content.encode())
    if rcp == "":
        return "recipient_required"
    if content == "":
        return "content_required"
    if n > 2048:
        return "content_too_large"
    if key == "":
        return "key_required"
    if len(key.encode()) > 255:
        return "key_too_long"
    if ch == "sms":
        if n > 160:
            return "sms_too_long"
        if not PHONE.fullmatch(rcp):
            return "sms_phone_format"
    elif ch == "email":
        if n > 2048:
            return "email_too_long"
        if "@" not in rcp:
            return "email_address_format"
    elif ch == "push":
        if n > 512:
            return "push_too_long"
    else:
        return "invalid_channel"
    if pr not in ("", "low", "normal", "high"):
        return "invalid_priority"
    return None


def test_random_requests_match_rules(spark):
    rnd = random.Random(9)
    pieces = ["", " ", "　", "\x85", "é", "ş", "x", "@", "+", "9", "0", "-", "\n", "İ"]
    rows = []
    for i in range(3000):
        blank = lambda: "".join(rnd.choice(WS) for _ in range(rnd.randint(0, 2)))
        key = blank() + "".join(rnd.choice("ab") for _ in range(rnd.choice([0, 3, 255, 256]))) + blank()
        rcp = blank() + rnd.choice(["+905551234567", "905551234567", "+1234", "a@b", "ab", "",
                                    "+90555" + "".join(rnd.choice(pieces) for _ in range(6))]) + blank()
        ch = blank() + rnd.choice(["sms", "SMS", "email", "Email", "push", "PUSH", "fax", ""]) + blank()
        content = blank() + "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 1, 80, 159, 161, 300, 600,
                                                                                     1100]))) + blank()
        pr = blank() + rnd.choice(["", "low", "NORMAL", "High", "urgent"]) + blank()
        rows.append((i, key, rcp, ch, content, pr))
    df = spark.createDataFrame(rows, "seq long, idempotency_key string, recipient string, channel string, "
                                     "content string, priority string")
    got = {r["seq"]: r["error"] for r in V.validate_requests(df).select("seq", "error").collect()}
    want = {r[0]: py_first_error(*r[1:]) for r in rows}
    assert got == want
