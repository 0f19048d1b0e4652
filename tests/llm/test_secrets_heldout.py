"""Precision and recall of the secret scan (1) on shapes that its own findings do not hold."""
import base64
import hashlib
import random
import string

from eventlens.llm.secrets import find_secrets

ALNUM = string.ascii_letters + string.digits


def _examples(n=40):
    rng = random.Random(21)
    some = lambda k, alphabet=ALNUM: "".join(rng.choice(alphabet) for _ in range(k - 1)) + rng.choice(string.digits)
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    secrets = {
        "gitlab": lambda: f"push with glpat-{some(20)} to it", "npm": lambda: f"//registry.example/:_authToken=npm_{some(36)}",
        "google": lambda: f"maps key AIza{some(35)} here", "sendgrid": lambda: f"export SENDGRID_API_KEY=SG.{some(22)}.{some(43)}",
        "heroku-like": lambda: f"HEROKU_API_KEY: {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", "db": lambda: f"db_password: '{some(14)}!'",
        "azure": lambda: f"AccountKey={base64.b64encode(rng.randbytes(64)).decode()}", "slack app": lambda: f"set xapp-1-A{some(10)}-{some(13)}-{hexa(64)}",
        "client": lambda: f"client_secret = \"{some(32)}\"", "restricted": lambda: f"use rk_live_{some(24)} for it",
        "aws temp": lambda: f"then ASIA{some(16, string.ascii_uppercase)} was used", "auth": lambda: f"auth_token={hexa(48)}",
    }
    harmless = {
        "etag": lambda: f"ETag {hexa(32)} was sent", "path": lambda: f"in /var/lib/images/{hexa(12)}/layer{rng.randint(100, 999)}/data.bin",
        "isbn": lambda: f"isbn 978-{rng.randint(0, 9)}-{rng.randint(100, 999)}-{rng.randint(10000, 99999)}-{rng.randint(0, 9)}",
        "package": lambda: f"org.apache.commons.lang{rng.randint(2, 9)}.builder.EqualsBuilder{rng.randint(10, 99)}",
        "session url": lambda: f"see https://shop.example/item/{rng.randint(10**9, 10**10)}?ref={some(6)}", "stamp": lambda: f"backup-2024{rng.randint(10, 12)}{rng.randint(10, 28)}-{rng.randint(100000, 235959)}.tar",
        "checksum": lambda: f"md5 {hashlib.md5(some(5).encode()).hexdigest()}  file.iso", "words": lambda: f"one_two_three_four_five_{rng.randint(10, 99)}_times",
        "iban": lambda: f"account DE{rng.randint(10**19, 10**20 - 1)} at the bank", "order": lambda: f"order ORD-{rng.randint(10**11, 10**12)}-{rng.randint(100, 999)} shipped",
        "placeholder": lambda: f"password=changeme_{rng.randint(1, 9)}{rng.randint(1, 9)}_example", "version": lambda: f"build 10.15.7-release-{rng.randint(1000, 9999)}-candidate",
    }
    rows = [(kind, 1, make()) for kind, make in secrets.items() for _ in range(n)] + [(kind, 0, make()) for kind, make in harmless.items() for _ in range(n)]
    return [(i, kind, label, text) for i, (kind, label, text) in enumerate(rows)]


def test_shapes_that_were_not_learned(spark):
    rows = _examples()
    df = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id bigint, text string")
    found = {r.doc_id for r in find_secrets(df).select("doc_id").distinct().collect()}
    true = [i for i, _, label, _ in rows if label]
    hit = sum(i in found for i in true)
    precision, recall = hit / max(1, len(found)), hit / len(true)
    by_kind = {}
    for i, kind, label, _ in rows:
        by_kind.setdefault((label, kind), []).append(i in found)
    print(f"precision {precision:.3f}, recall {recall:.3f}", {k: round(sum(v) / len(v), 2) for k, v in by_kind.items()})
    assert precision >= 0.95 and recall >= 0.95
