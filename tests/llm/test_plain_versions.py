"""Secret scans, alias verdicts and the language model's sample against plain versions."""

from __future__ import annotations

import random
import string

import pytest

from strandline.llm import langid, secrets, urls
from strandline.llm.queries import RULES

# ---- secrets: the base kinds, character by character

NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def plain_base(text):
    found, at = [], 0
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    while at < len(text):
        hit = None
        for name in NAMES:
            if not lower.startswith(name, at):
                continue
            for quoted in (1, 0):
                k = at + len(name)
                if quoted:
                    if text[k : k + 1] not in ('"', "'") or not text[k : k + 1]:
                        continue
                    k += 1
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                begin = k + (text[k : k + 1] in ('"', "'") and bool(text[k : k + 1]))
                end = begin
                while end < len(text) and text[end] in VALUE:
                    end += 1
                if end > begin:
                    hit = (at, end, begin)
                    break
            if hit:
                break
        if hit:
            if hit[1] - hit[2] >= 12:
                found.append((hit[0], hit[1], 0))
            at = hit[1]
        else:
            at += 1
    for kind, letters, head, least in ((1, set(string.ascii_uppercase + string.digits), "AKIA", 18), (2, set("0123456789abcdef"), "", 16)):
        at = 0
        while at < len(text):
            end = at + len(head)
            if text.startswith(head, at):
                while end < len(text) and text[end] in letters:
                    end += 1
            if text.startswith(head, at) and end > at + len(head):
                if end - at >= least:
                    found.append((at, end, kind))
                at = end
            else:
                at += 1
    return sorted(found)


@pytest.mark.parametrize("seed", range(40))
def test_base_kinds_are_those_of_a_plain_scanner(seed):
    r = random.Random(seed)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "api-key", "AKIA", "akia", ":", "=", ": ", " = ", '"', "'", " ", "\n", "é", "ſecret", "toKen", "a1b2c3d4", "deadbeefdeadbeef0", "A1B2C3D4E5F6G7", "x.y_z", "abcdefghijkl", "==", "token=token=abcdefghijklmnop", "0" * 15]
    novelty = secrets.Novelty()
    for _ in range(60):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [x for x in secrets.scan_text(text, novelty) if x[2] < 3] == plain_base(text), text


def test_names_that_the_dictionary_lacks_are_no_keys():
    """Words of four languages, none of them in the dictionary, and file names, dates and paths; and keys of all alphabets."""
    known = "the house was empty and nobody had come over hill river window garden morning letter station number between under against people water through general interest nation nature train plant order central member strong".split()
    held = {
        "de": "gesellschaft versicherung schifffahrt donau dampf recht schutz haupt bahnhof freund lich keit zeit geist arbeit wohnung strasse".split(),
        "fr": "constitution nellement heureusement bibliotheque maison fenetre lumiere chemin toujours quelque chose autour demain".split(),
        "es": "electro encefalo grafista ventana camino siempre pueblo montana corazon trabajo desarrollo ciudad tiempo".split(),
        "en": "pneumono ultra microscopic silico volcano framework security provider factory credential singleton transaction".split(),
    }
    fixed = ["Donaudampfschifffahrtsgesellschaft", "pneumonoultramicroscopicsilicovolcanoconiosis", "org_springframework_security_oauth2_provider", "base64EncodedCredentialProviderFactoryBean", "2024-11-26T17-43-56_log-rotate", "/home/jzk/dbg/qrx/tmp/xvf/wqt", "AbstractSingletonProxyFactoryBean", "internationalization_settings_v2"]
    novelty, r = secrets.Novelty(" ".join(known)), random.Random(6)
    is_key = lambda x: any(k == 3 for _, _, k in secrets.scan_text(f"and after that the session token is {x} and so on", novelty))
    names = list(fixed)
    for words in held.values():
        for join in ("_".join, "".join, "/".join, "-".join, lambda x: "".join(w.title() for w in x)):
            names += [x for x in (join([r.choice(words) for _ in range(r.randint(2, 5))]) for _ in range(60)) if len(x) >= 16]
    false = [x for x in names if is_key(x)]
    assert len(names) > 1000 and len(false) < 0.01 * len(names), false[:20]
    assert not set(false) & set(fixed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", "0123456789ABCDEF", string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/"]
    for letters in alphabets:
        hits = [is_key("".join(r.choice(letters) for _ in range(n))) for n in (16, 20, 24, 32, 64, 200) for _ in range(50)]
        assert sum(hits) >= 0.95 * len(hits), (letters, sum(hits), len(hits))


# ---- urls: verdicts carried over chains, cycles and trees of aliases


def plain_verdicts(pages, links):
    def rule_of(host, path):
        fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=(0, None, None))[1:]

    def parts(u):
        rest = u.split("://", 1)[1].split("#")[0]
        host = rest.split("/")[0].split("?")[0]
        return host.lower(), rest[len(host) :].split("?")[0], rest[len(host) :]

    near = {}
    for a, b in links:
        (h1, _, r1), (h2, _, r2) = parts(a), parts(b)
        near.setdefault(h1 + r1, set()).add(h2 + r2)
        near.setdefault(h2 + r2, set()).add(h1 + r1)
    out = {}
    for i, u in pages:
        host, path, rest = parts(u)
        verdict, rule = rule_of(host, path)
        if verdict is None:
            seen, todo = {host + rest}, [host + rest]
            while todo:
                for x in near.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            said = {rule_of(x.split("/")[0], "/" + x.split("/", 1)[1].split("?")[0])[0] for x in seen}
            verdict = "block" if "block" in said and "allow" not in said else "allow"
        out[i] = (rule, verdict)
    return out


def test_verdicts_over_random_aliases(spark):
    r = random.Random(11)
    hosts = [f"h{k}.org" for k in range(60)] + ["example.com", "www.example.com", "b.net", "x.com"]
    urls_ = [f"http://{r.choice(hosts) if r.random() < 0.94 else r.choice(hosts[-4:])}/{r.choice(['en', 'es', 'fr', 'a'])}/{k}{r.choice(['', '?q=1'])}" for k in range(3000)]
    links = [(r.choice(urls_), r.choice(urls_)) for _ in range(900)]
    links += list(zip(urls_[:80], urls_[1:80], strict=False)) + [(urls_[79], urls_[0])]  # a cycle
    links += [(u, urls_[100]) for u in urls_[101:300]]  # a star
    pages = list(enumerate(urls_))
    by = {}
    for a, b in links[:1000]:
        by.setdefault(a, []).append(b)
    tag = lambda k, u: f'<link rel=canonical href="{u}">' if k % 2 else f'<meta http-equiv="refresh" content="3;url={u}">'
    first = {u: i for i, u in reversed(pages)}
    html = {first[a]: "".join(tag(k, b) for k, b in enumerate(bs)) for a, bs in by.items()}
    df = spark.createDataFrame([(i, u, html.get(i)) for i, u in pages], "page_id long, url string, html string")
    more = spark.createDataFrame(links[1000:], "source string, target string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in urls.judge(df, RULES, more).collect()}
    want = plain_verdicts(pages, links)
    assert got == want
    blocked = sum(rule is None and v == "block" for rule, v in want.values())
    assert blocked > 20 and sum(rule is None and v == "allow" for rule, v in want.values()) > 20


# ---- language ID: what the sample is bound by


@pytest.mark.parametrize("keys", ["null", "one", "own"])
def test_the_sample_is_bound_whatever_the_keys(spark, monkeypatch, keys):
    """Rows of a language without keys, or with one key, are drawn as those with keys of their own are; repeats count once."""
    r = random.Random(2)
    own = {"null": lambda k: None, "one": lambda k: 7, "own": lambda k: k}[keys]
    mark = lambda k: "w" + "".join("ghijklmnop"[int(c)] for c in str(k)) + "x"
    rows = [(own(k), f"{mark(k)} common words " + " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(4)), "en") for k in range(400)]
    rows += [(own(1000 + k), f"andere worte {k}", "de") for k in range(30)] + [(own(2000), "copied text of one row", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    monkeypatch.setattr(langid, "LEAST_COUNT", 1)
    model = langid.fit(docs, sample=50)
    drawn = sum(mark(k) in model.tables[0] for k in range(400))
    assert 20 <= drawn <= 85
    assert "andere" in model.tables[0] and model.langs == ["de", "en"]
    known = set(model.tables[0])
    assert set(langid.fit(docs.repartition(3), sample=50).tables[0]) == known
