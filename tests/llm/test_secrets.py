"""Lexed spans of made programs, whose secrets are known by how they were made, and linear time."""

import random
import time

import pytest

from driftline.llm import secrets

rng = random.Random(23)
LETTERS = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
SENSITIVE = ["password", "db_password", "clientSecret", "AUTH_TOKEN", "service.api_key", "access-token"]
PLAIN = ["colour", "user_name", "retries", "log.level", "Title"]


def literal():
    return "".join(rng.sample(LETTERS, 14)) + rng.choice("0123456789")


#: name and literal in the syntaxes that are read; the literal stands once.
FORMS = ["{n} = \"{v}\"", "{n}: '{v}'", "\"{n}\": \"{v}\",", "{n} := `{v}`", "'{n}' => '{v}'", "{n}={v}", "export {n}={v}", "--{n}={v}", "{n}: str = r\"{v}\"", "env[\"{n}\"] = \"{v}\"", "<{n}>{v}</{n}>", "<{n} kind='x'> {v} </{n}>", "{n}: |\n    {v}\nnext: 1", "{n} = \"\"\"{v}\"\"\"", "# {n} = {v}", "call({n}=\"{v}\")", "// {n}: \"{v}\""]


def spans(text):
    return {text[a:b] for a, _, b in secrets.lexed_spans(text)}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    for _ in range(20):
        value, other = literal(), literal()
        text = form.format(n=rng.choice(SENSITIVE), v=value) + "\n" + form.format(n=rng.choice(PLAIN), v=other) + "\n"
        assert spans(text) == {value}, text
        at = text.index(value)
        assert [(a, b) for a, _, b in secrets.lexed_spans(text)] == [(at, at + len(value))]


def program():
    """A program of nested scopes, and the literals that its sensitive names reach, worked out while it is written."""
    lines, reached, uses = [], set(), []

    def block(bound, depth, margin):
        bound = dict(bound)
        for _ in range(rng.randint(5, 12)):
            pad, kind = " " * margin, rng.randint(0, 6)
            name = rng.choice("abcdef")
            if kind <= 1:
                bound[name] = literal()
                lines.append(f"{pad}{name} = '{bound[name]}'")
            elif kind == 2:
                bound[name] = None
                lines.append(f"{pad}{name} = compute(1)")
            elif kind == 3:
                other = rng.choice("abcdef")
                if other in bound:
                    bound[name] = bound[other]
                    lines.append(f"{pad}{name} = {other}")
            elif kind == 4 and name in bound:
                lines.append(f"{pad}conf.{rng.choice(SENSITIVE).replace('-', '_')} = {name}")
                reached.add(bound[name])
            elif kind == 5 and depth < 3:
                lines.append(f"{pad}def work_{depth}(x):")
                block(bound, depth + 1, margin + 4)
            elif kind == 6:
                lines.append(f"{pad}# {name} = '{literal()}'")
        uses.append(bound)

    block({}, 0, 0)
    return "\n".join(lines) + "\n", reached - {None}


def test_programs():
    some = 0
    for _ in range(300):
        text, reached = program()
        assert spans(text) == reached, text
        some += bool(reached)
    assert some > 100


def test_braces_are_scopes():
    outer, inner = literal(), literal()
    assert spans(f"k = '{outer}'\nif (x) {{ k = '{inner}'; }}\nsecret = k\n") == {outer}
    assert spans(f"k = '{outer}'\nif (x) {{ secret = k }}\n") == {outer}
    assert spans("secret = k\n}}}\n") == set()


def test_long_names_and_types():
    """Subscripts and annotations of any length; a padded literal is no annotation, nor are the words of a sentence."""
    for _ in range(20):
        v, far = literal(), "x" * rng.randint(190, 3000)
        kinds = ", ".join(f"Kind{i}" for i in range(rng.randint(5, 300)))
        assert spans(f'config["{far}"]["password"] = "{v}"') == {v}
        assert spans(f'config["{far}_password"] = "{v}"') == {v}
        assert spans(f'password: dict[{kinds}] | None = "{v}"') == {v}
        assert spans(f'password: {" | ".join(["str"] * 50)} = "{v}"') == {v}
        padded = "".join(rng.choice(LETTERS) for _ in range(rng.choice([20, 90]))) + "7"
        for end in ("=", "==", "=\nnext: 1", "=}"):
            assert any(padded in x for x in spans(f"token: {padded}{end}")), (padded, end)
        assert spans(f"note: some words of a sentence, password = {v}") == {v}


def test_linear_time():
    n = 100_000
    for junk in ("a: b[" + "c, " * 60_000, "a: b" + "[x]" * 60_000, "a: b" + " | c[d]" * 40_000, "a[" * 60_000, "a[" + "b" * 200_000, "a" + "[b]" * 60_000, "a" * n, "secret " + "a" * 10 * n, "secret=: " + "a." * n + '"', 'secret "' + '\\"' * n, "secret " + "{" * n + "}" * n, "secret " + "<a>" * n, "secret " + "k=v " * n, "secret x" + "[a]" * n, "secret: |\n" * (n // 10), 'secret = """' * (n // 10), "secret\n" + "# " * n):
        start = time.time()
        secrets.scan_text(junk)
        assert time.time() - start < 5, junk[:12]


def test_rows(spark):
    value = literal()
    rows = [(1, None, "a"), (1, "", "b"), (2, f"token = '{value}'", None), (2, f"token = '{value}'", None), (None, "x" * 1_000_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    assert sorted(len(r.secrets) for r in secrets.scan(df).collect()) == [0, 0, 0, 2, 2]
    clean = secrets.redact(df)
    assert clean.columns == df.columns and sorted(str(r.text)[:9] for r in clean.collect()) == sorted(["None", "", "[SECRET]'", "[SECRET]'", "xxxxxxxxx"])
    assert secrets.scan(df.limit(0)).count() == 0
