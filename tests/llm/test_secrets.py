"""Secret scans: base spans against a search by hand, assignments by hand-derived cases."""

import hashlib
import random

import pytest

from cairn.llm import secrets
from cairn.llm.common import stage

KEY = "tG7w9Qz2LmN4xK8p"


def by_hand(text):
    """Base spans, found character by character."""
    out, word = [], set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")

    def run(at, letters):
        while at < len(text) and text[at] in letters:
            at += 1
        return at

    at = 0
    while at < len(text):
        hit = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c.isascii() else c for c in text[at : at + len(name)]) == name:
                p = at + len(name)
                p += text[p : p + 1] in ("'", '"') and p < len(text)
                p = run(p, " ")
                if text[p : p + 1] in (":", "=") and p < len(text):
                    p = run(p + 1, " ")
                    p += text[p : p + 1] in ("'", '"') and p < len(text)
                    end = run(p, word)
                    if end > p:
                        hit = end, end - p >= 8
        if hit and hit[1]:
            out.append(("assign", at, hit[0]))
        at = hit[0] if hit else at + 1
    for kind, letters, start, least in (("access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 16), ("hex", set("0123456789abcdef"), "", 32)):
        at = 0
        while at < len(text):
            end = run(at + len(start), letters) if text.startswith(start, at) and text[at] in letters else at
            if end > at + (len(start) if start else 0):
                out += [(kind, at, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    return sorted(out)


def test_base_spans_by_hand():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "ſecret", "toKen", "Token", "api_key", "apikey", "API-KEY", " ", "  ", "=", ":", '"', "'", "AKIA", "AKIAABCDEFGH1234", "ABCD", "0123456789abcdef", "é😀", "\n", "abc", "x.y/z+==", "12345678", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert sorted(secrets.base_spans(text)) == by_hand(text), text
        assert {s[:3] for s in secrets.secrets_of(text)} >= set(by_hand(text))


FOUND = [
    f'password = "{KEY}"', f"db_passwd: {KEY}", f'{{"client": {{"clientSecret": "{KEY}"}}}}', f"export AWS_SECRET_ACCESS_KEY={KEY}",
    f"config['api_key'] = '{KEY}'", f"const apiKey: string = `{KEY}`;", f"'auth_token' => '{KEY}',", f"let pass_phrase := \"{KEY}\"\npassphrase = pass_phrase",
    f"<password>{KEY}</password>", f'<add key="DbPassword" value="{KEY}" />', f'a = "{KEY}"\nb = a\nc = b\ntoken = c', f"BASE={KEY}\nexport API_TOKEN=${{BASE}}",
    f'settings.secret = r"{KEY}"  # note', f"PRIVATE_KEY={KEY}==", f'self.x = "{KEY}"\nlogin(user, password=x)', f"url?access_token={KEY}&x=1",
]
CLEAN = [
    "The token: a word that stands for another. The secret = a matter of time.", "password = getpass.getpass()", 'token = os.environ["TOKEN"]', "password: ${PASSWORD}", 'secret = "changeme"', "password_file = /etc/app/Password1.txt",
    'token_count = "1234567890ab"', f'checksum = "{KEY}"', f'public_key = "{KEY}"', "if (password == other) { x => y }", 'passwords = ["a", "b"]', f'a = "{KEY}"\na = read()\ntoken = a', "key: value", "secret: |", "token =", "api_key", "",
    "password = correct horse battery", 'secret = "aaaaaaaaaaaa"', f'title = "{KEY}"', "std::token::value", "https://example.com/token:8080/", 'tokens: "none of these"',
]


@pytest.mark.parametrize("text", FOUND)
def test_literals_that_reach_sensitive_names(text):
    spans = secrets.literal_spans(text)
    assert any(text[a:b].rstrip("=") == KEY for a, b in spans), spans


@pytest.mark.parametrize("text", CLEAN)
def test_other_names_and_values_are_left_alone(text):
    assert secrets.literal_spans(text) == {}


def test_pieces_of_a_constant():
    text = f'head = "{KEY[:7]}"\ntail = "{KEY[7:12]}"\nsecret = head + tail + "{KEY[12:]}"\nprint(f"{{head}}")\napi_key = f"{{head}}-{{tail}}"\n'
    assert [text[a:b] for a, b in sorted(secrets.literal_spans(text))] == [KEY[:7], KEY[7:12], KEY[12:], "-"]
    assert len(secrets.literal_spans("token = '" + "aB3$" * 2000 + "'")) == 0


@pytest.mark.parametrize("unit", ["a=", "a:", 'token="', "token='x' + ", "x" * 50 + "=", "a = a + a\n", "<a>", "$", "{", 'k = "' + KEY + '"\ntoken = k\n', "password: token: "])
def test_time_is_linear_in_the_text(unit):
    import time

    began = time.time()
    secrets.secrets_of(unit * (400_000 // len(unit)))
    assert time.time() - began < 8


def test_rows(spark):
    long = "prose " * 400_000 + f'secret = "{KEY}"'
    rows = [(1, None, 0), (1, "", 1), (None, f"token: {KEY}", 2), (2, long, 3), (2, f"token: {KEY}", 4), (2, f"token: {KEY}", 5), (3, "é " + "f" * 33, 6)]
    table = stage(spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3))
    got = sorted((str(r.doc_id), [tuple(s)[:3] for s in r.spans]) for r in secrets.found(table).collect())
    at = len(long) - len(KEY) - 1
    token = [("assign", 0, 7 + len(KEY)), ("literal", 7, 7 + len(KEY))]
    assert got == sorted([("1", []), ("1", []), ("None", token), ("2", [("assign", at - 10, at + len(KEY)), ("literal", at, at + len(KEY))]), ("2", token), ("2", token), ("3", [("hex", 2, 35)])])
    assert secrets.found(table.limit(0)).count() == 0
    row = secrets.found(table.filter("doc_id is null")).select(secrets.joined("spans").alias("s")).first()
    assert row.s == f"assign:0:{7 + len(KEY)},literal:7:{7 + len(KEY)}" and hashlib.sha256(row.s.encode()).hexdigest()
