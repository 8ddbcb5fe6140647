"""A token is judged at each of its places."""

import random
import time

from panelfx.llm import secret_scan


def test_every_place_is_judged(spark):
    t = "3f9a1c7e5b2d8064af13ce97b8d2450f6e1a9c3b"
    texts = [
        f"see commit {t} for it, later api_key={t} was set",
        f"http://host/files/{t}/a.html and then secret = '{t}' here",
        f"api_key={t} came first, then commit {t}",
        f"see commit {t} for it, and again commit {t}",
        f"commit {t} " + "ordinary prose " * 400 + f"token: {t}",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(d, secret_scan.default_forest(spark)).collect()}
    for k in (0, 1, 2, 4):
        assert got[k]["secret_found"] == [t] and t not in got[k]["secret_text"]
    assert got[3]["secret_found"] == [] and got[3]["secret_text"] == texts[3]
    assert [c["token"] for c in got[0]["secret_candidates"]] == [t]


def test_context_reaches_over_neighbours(spark):
    """Tokens in a row: each window is the text around the place, cut nowhere else."""
    tokens = [f"{k}bcdef0123456789" for k in range(6)]
    text = "the password " + " ".join(tokens) + " end"
    d = spark.createDataFrame([(0, text)], "doc_id int, text string")
    leaf = [("key_word", 0.5, 0.0, 1.0)]
    found = secret_scan.scan(d, leaf).first()["secret_found"]
    # the key word stands at most 16 characters before a token
    assert found == tokens[:1]
    plain = secret_scan.scan(d, [("length", 1e9, 0.0, 1.0)]).first()
    assert [c["token"] for c in plain["secret_candidates"]] == tokens and plain["secret_text"] == text


def findings(n=600, seed=5):
    """Texts with one candidate, in forms that the training templates don't have: (text, token, label)."""
    r = random.Random(seed)
    hexd, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    weak = ["hunter2", "Tr0ub4dor&3", "s3cr3tPass", "letmein99", "P@ssw0rd1", "qwerty!23", "dragon2020", "M0nkey#77", "iloveyou12", "C0rrectH0rse"]
    plain = ["correct", "sequence", "required", "between", "element", "provided", "according", "nothing", "literal", "parameter"]
    out = []
    for k in range(n):
        form = k % 12
        if form == 0:
            out.append((f"export DB_PASSWORD={(t := r.choice(weak))}\nexport DB_HOST=db1", t, 1))
        elif form == 1:
            out.append((f'{{"user": "bob", "password": "{(t := r.choice(weak))}", "port": 5432}}', t, 1))
        elif form == 2:
            out.append((f"DATABASE_URL=postgres://bob:{(t := r.choice(weak))}@db.internal:5432/app", t, 1))
        elif form == 3:
            out.append((f"curl -H 'X-Api-Key: {(t := pick(b62, 32))}' https://host/v1", t, 1))
        elif form == 4:
            out.append((f"client = connect(api_key='{(t := pick(hexd, 32))}', region='x')", t, 1))
        elif form == 5:
            out.append((f"[default]\naws_access_key_id = {(t := 'AKIA' + pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16))}\n", t, 1))
        elif form == 6:
            out.append((f"merge of branch x at commit {(t := pick(hexd, 40))} by ann", t, 0))
        elif form == 7:
            out.append((f'"integrity": "sha512-{(t := pick(b62, 44))}", checksum', "sha512-" + t, 0))
        elif form == 8:
            out.append((f"the field password: {(t := r.choice(plain))} in the form", t, 0))
        elif form == 9:
            out.append((f"password = os.environ['{pick(b62[:26], 8)}'] # from the shell", "os.environ", 0))
        elif form == 10:
            out.append((f"see /assets/2024/{(t := pick(hexd, 20))}/photo.png for it", t, 0))
        else:
            out.append((f"token=${{{(t := 'CI_' + pick(b62[:26], 8))}}} make deploy", "${" + t, 0))
    return out


def test_held_out_findings(spark):
    made = findings()
    d = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(made)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(d, secret_scan.default_forest(spark)).collect()}
    caught = sum(any(t in f for f in got[k]["secret_found"]) for k, (_, t, y) in enumerate(made) if y)
    false = sum(bool(got[k]["secret_found"]) for k, (_, _, y) in enumerate(made) if not y)
    recall, precision = caught / sum(y for *_, y in made), caught / max(caught + false, 1)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert recall > 0.9 and precision > 0.9


def test_short_values_urls_and_longer_tokens(spark):
    t = "af91c6089defd4da03"
    texts = [
        ("set password=hunter2 now", "set password=[SECRET] now"),
        ('password="Tr0ub4dor&3"', 'password="[SECRET]"'),
        ("go postgres://bob:s3cr3tPass@db/app there", "go postgres://bob:[SECRET]@db/app there"),
        (f"commit {t} ok. later password={t}", "commit [SECRET] ok. later password=[SECRET]"),
        (f"password={t} then /img/{t}abcdef0123/photo.png", f"password=[SECRET] then /img/{t}abcdef0123/photo.png"),
        ("the password: required and the token = nothing", None),
        ("a token of our time, password reset, secret: unknown", None),
    ]
    d = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["secret_text"] for r in secret_scan.scan(d, secret_scan.default_forest(spark)).collect()}
    assert got == {k: b or a for k, (a, b) in enumerate(texts)}


def test_long_key_dump_takes_linear_time(spark):
    r = random.Random(1)
    lines = [f"k{k} password={r.getrandbits(80):020x}" for k in range(12_000)]
    forest = [("length", 1e9, 1.0, 0.0)]
    took = []
    for n in (3_000, 12_000):
        d = spark.createDataFrame([(1, "\n".join(lines[:n]))], "doc_id int, text string")
        began = time.time()
        row = secret_scan.scan(d, forest).selectExpr("size(secret_found) AS n", "length(secret_text) AS m", "instr(secret_text, 'password=[SECRET]') AS at").first()
        took.append(time.time() - began)
        assert row["n"] == n and row["at"] > 0
    assert took[1] < 8 * took[0] + 2
