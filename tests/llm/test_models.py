import re

import numpy as np
import pytest

from lexloom.llm import crf_pii, gru_language, string_kernel

FR = "le chat noir dort sur la grande table rouge avec une petite souris"
EN = "the black cat sleeps on the large red table with a small mouse"


def language_rows():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(120):
        words = (EN, FR)[k % 2].split()
        rows.append((k, " ".join(rng.choice(words, 12)), ("en", "fr")[k % 2]))
    return rows


def test_language_is_learnt_and_held_out_rows_are_right(documents):
    rows = language_rows()
    net = gru_language.fit(documents(rows[:80]))
    got = gru_language.predict(documents(rows[80:]), net, ["doc_id"]).collect()
    want = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(documents, odd):
    net = gru_language.fit(documents(language_rows()))
    got = {r.doc_id: r for r in gru_language.predict(documents(odd), net, ["doc_id"]).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 7))
    assert got[8].lang_pred in ("en", "fr")
    assert gru_language.fit(documents([])) is None
    assert {r.lang_pred for r in gru_language.predict(documents(odd), None, ["doc_id"]).collect()} == {"und"}
    assert gru_language.predict(documents([]), net, ["doc_id"]).count() == 0


def reference_labels(net, data):
    """Labels of every byte of one whole text, a step at a time, in double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    soft = lambda x: x / (1 + np.abs(x))
    states = {}
    for side, order in (("f", range(len(data))), ("b", range(len(data) - 1, -1, -1))):
        h, u = np.zeros(gru_language.HIDDEN), p["u" + side]
        for t in order:
            x, n = p["w" + side][data[t]], gru_language.HIDDEN
            z, r = (0.5 + 0.5 * soft(x[k * n : (k + 1) * n] + h @ u[:, k * n : (k + 1) * n]) for k in (0, 1))
            h = z * h + (1 - z) * soft(x[2 * n :] + (r * h) @ u[:, 2 * n :])
            states[side, t] = h
    out = np.array([np.r_[states["f", t], states["b", t]] @ p["o"] + p["c"] for t in range(len(data))])
    e = np.exp(out - out.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bags_of(*texts):
    return [(language, gru_language.pieces(t)) for language, t in texts]


def test_every_byte_gets_a_label_and_gradients_are_right():
    net = gru_language.Network.train(bags_of(("a", EN), ("b", FR)))
    ids = np.frombuffer(b"mouse", np.uint8).astype(np.int64)[None]
    labels = net.labels(ids.T)
    assert labels.shape == (5, 1, 2) and np.allclose(labels.sum(2), 1, atol=1e-5)
    assert np.allclose(labels[:, 0], reference_labels(net, b"mouse"), atol=1e-4)
    mask, want = np.ones((1, 5), np.float32), np.array([0])
    gradient = net._gradient(ids, mask, want)

    def loss():
        return -np.log(net.labels(ids.T)[:, 0, 0]).mean()

    for name, at in (("uf", (3, 5)), ("ub", (1, 30)), ("o", (2, 1)), ("wf", (ord("u"), 7))):
        step = 1e-2
        net.p[name][at] += step
        high = loss()
        net.p[name][at] -= 2 * step
        low = loss()
        net.p[name][at] += step
        assert gradient[name][at] == pytest.approx((high - low) / (2 * step), abs=2e-3)


def test_whole_texts_are_read_byte_for_byte():
    """Every byte votes once, labelled as by a plain pass over its span and margins."""
    net = gru_language.Network.train(bags_of(("a", EN), ("b", FR)))
    texts = ["é", EN, f"{FR}! 12 {EN}", "x", (EN + " ") * 14 + (FR + " ") * 9, "日本 " * 70]
    for text, got in zip(texts, net.pooled([gru_language.encoded(t) for t in texts])):
        data = gru_language.encoded(text)
        count, want, seen = -(-len(data) // gru_language.SPAN), 0, 0
        for k in range(count):
            low, high = len(data) * k // count, len(data) * (k + 1) // count
            first, last = max(0, low - gru_language.MARGIN), min(len(data), high + gru_language.MARGIN)
            votes = np.array([b >= 128 or chr(b).isalpha() for b in data[low:high]])
            want = want + reference_labels(net, data[first:last])[low - first : high - first][votes].sum(0)
            seen += votes.sum()
        assert got.sum() == pytest.approx(seen, rel=1e-4) and np.allclose(got, want, rtol=2e-3, atol=2e-3 * seen)


def test_rows_without_an_id_are_learnt_from_in_bounds(spark):
    rows = spark.range(50_000).selectExpr("cast(null as long) doc_id", "concat('le chat noir ', id) text", "'fr' lang")
    rows = rows.unionByName(spark.createDataFrame([(k, EN, "en") for k in range(400)], "doc_id long, text string, lang string"))
    seen = []
    train = gru_language.Network.train
    gru_language.Network.train = lambda samples, seed=7: seen.extend(samples)
    try:
        gru_language.fit(rows)
    finally:
        gru_language.Network.train = train
    languages = [s[0] for s in seen]
    assert 200 < languages.count("fr") <= 2 * gru_language.SAMPLE_DOCS and languages.count("en") == 1


def kernel_by_brute_force(a, b, order, decay):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), order):
        for j in combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_the_kernel_counts_gapped_subsequences():
    """Of words between marks of their ends, which are letters of the kernel."""
    words, marks = ["idiot", "idxiot", "table", "ab", "aaaa"], ["idiot", "tablet", "aaa"]
    got = string_kernel.kernel(words, marks)
    for k, w in enumerate(words):
        for m, mark in enumerate(marks):
            want = kernel_by_brute_force(f"^{w}$", f"^{mark}$", string_kernel.ORDER, string_kernel.DECAY)
            assert got[k, m] == pytest.approx(want, rel=1e-4, abs=1e-6)
        own = kernel_by_brute_force(f"^{w}$", f"^{w}$", string_kernel.ORDER, string_kernel.DECAY)
        assert string_kernel.self_kernel([w])[0] == pytest.approx(own, rel=1e-4, abs=1e-6)


def toxic_bags():
    rng = np.random.default_rng(1)
    clean = "the quick brown fox jumps over many lazy dogs while rivers flow past green hills toward distant silver towns".split()
    bags = []
    for k in range(200):
        words = list(rng.choice(clean, 20))
        if k % 4 == 0:
            words[3] = ("idiot", "moron", "worthless")[k % 3]
        bags.append((int(k % 4 == 0), " ".join(words)))
    return bags


def test_the_table_of_triples_is_the_machine():
    machine = string_kernel.Machine.train(toxic_bags())
    words = ["idiot", "idxiot", "fox", "hills", "zzzzqqq", "worthlesss"]
    want = machine.vectors(words) @ machine.weights + machine.bias
    assert np.allclose(machine.rate(words), np.maximum(want, string_kernel.LOWEST), atol=1e-3)
    assert machine.rate(["a", "lo"]).tolist() == [string_kernel.LOWEST] * 2


def test_words_of_any_alphabet_are_weighed_alike(monkeypatch):
    rng = np.random.default_rng(4)
    letters = [chr(0x4E00 + k) for k in range(2000)]
    bags = [(k % 2, " ".join(["壞人們啊" if k % 2 else "好天氣呢", *("".join(rng.choice(letters, 6)) for _ in range(12))])) for k in range(120)]
    machine = string_kernel.Machine.train(bags)
    assert machine.table is None and len(machine.triples) < 400_000
    words = ["壞人們啊", "好天氣呢", "".join(letters[:5])]
    want = machine.vectors(words) @ machine.weights + machine.bias
    assert np.allclose(machine.rate(words), np.maximum(want, string_kernel.LOWEST), atol=1e-3)


def test_long_labelled_texts_are_learnt_from(spark, documents):
    long = [(k, f"{text} " + "green hills of silver " * 400) for k, (_, text) in enumerate(toxic_bags())]
    assert min(len(t) for _, t in long) > 7000
    labels = spark.createDataFrame([(k, y) for k, (y, _) in enumerate(toxic_bags())] * 2, "doc_id long, toxic int")
    machine = string_kernel.fit(documents(long + long[:20]), labels)
    got = string_kernel.Scorer(machine).score(["you idiot", "green hills"])
    assert got[0] >= 0.5 > got[1]


def test_insults_are_found_with_gaps_and_inserted_letters(documents):
    machine = string_kernel.Machine.train(toxic_bags())
    texts = ["You IDIOT!", "such an id-iot here", "an i d i o t again", "a wortthless thing", "moroon", "lazy dogs flow past"]
    got = string_kernel.Scorer(machine).score(texts)
    assert all(s >= 0.5 for s in got[:5]) and got[5] < 0.5


def test_toxicity_of_odd_rows(spark, documents, odd):
    machine = string_kernel.Machine.train(toxic_bags())
    got = {r.doc_id: r for r in string_kernel.predict(documents(odd), machine, ["doc_id"]).collect()}
    assert len(got) == len({r[0] for r in odd}) and all(0 <= r.score <= 1 for r in got.values())
    assert got[1].predicted == got[2].predicted == got[7].predicted == 0
    labels = spark.createDataFrame([(1, 0), (1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert string_kernel.fit(documents(odd), labels) is None
    assert {r.score for r in string_kernel.predict(documents(odd), None, ["doc_id"]).collect()} == {0.0}


def test_base_patterns_match_as_written():
    texts = [
        "a.b+c@x-y.com.org, @no.where z@nodot q@a.b@c.d", "1.2.3.4 1.2.3.4.5 256.1.1.1 1.2.3 0001.02.3.255.9.9.9.9",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34", "+1 (234) 555-7890 +12 +1234567890123456 +1-2-3-4-5-6-7-8-9-",
        "é" * 10 + "x@y.zz 😀 4111111111111111", "",
    ]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    for text in texts:
        want = [("email", *m.span()) for m in email.finditer(text)]
        want += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        want += [("card", *m.span()) for m in card.finditer(text) if 13 <= len(digits(m.group())) <= 19 and crf_pii.luhn(digits(m.group()))]
        want += [("phone", *m.span()) for m in phone.finditer(text) if 9 <= len(digits(m.group())) <= 15]
        assert crf_pii.base_spans(text) == want


def test_viterbi_and_marginals_against_enumeration():
    from itertools import product

    model = crf_pii.field()
    tokens = crf_pii.tokenize("tel (212) 555")[:4]
    named = crf_pii.features(tokens)
    ids, lengths = model._ids([named])
    score = model.emit[ids].sum(2)[0]
    best, total = None, {}
    for path in product(range(len(crf_pii.LABELS)), repeat=len(tokens)):
        value = model.first[path[0]] + sum(score[t, y] for t, y in enumerate(path))
        value += sum((model.move + model.forbid)[a, b] for a, b in zip(path, path[1:]))
        total[path] = value
        best = path if best is None or value > total[best] else best
    assert model.decode([named])[0] == list(best)
    weights = np.array(list(total.values()))
    norm = np.exp(weights - weights.max())
    near = model._expect(ids, lengths)[0][0]
    for y in range(len(crf_pii.LABELS)):
        mass = sum(p for path, p in zip(total, norm / norm.sum()) if path[2] == y)
        assert near[2, y] == pytest.approx(mass, abs=1e-6)


def test_the_field_adds_spans_clear_of_base_ones():
    model = crf_pii.reader()
    texts = ["mail john (at) example (dot) com now", "call (212) 555-0199 today", "+1 (212) 555-0199 rang", "plain words, version 2.0 only", None]
    got = crf_pii.find(texts, model)
    assert got[0][1] == [("email", 5, 32)] and got[1][1] == [("phone", 5, 19)]
    assert got[2][0] == got[2][1] and got[3][1] == [] and got[4] == ([], [])
    assert crf_pii.mask("a x@y.zz b", got_spans := crf_pii.base_spans("a x@y.zz b")) == "a <EMAIL> b" and got_spans


def test_data_without_a_digit_or_an_at_sign_is_found_and_words_beside_it_stay():
    model = crf_pii.reader()
    for text, want in (
        ("password: correcthorse please", "correcthorse"), ("Call 212-555-0199 now", "212-555-0199"),
        ("mail jane at mail dot org now", "jane at mail dot org"), ("call us: 212-555-0199; today", "212-555-0199"),
    ):
        assert [text[a:b] for _, a, b in crf_pii.find([text], model)[0][1]] == [want]


#: Other sentences than the labelled table's, filled in the same way.
HELD_OUT = """
please mail {email:~~~~~ (at) ~~~~~~ (dot) org} soon
you can write to {email:~~~~ [at] ~~~~~~~~ [dot] com}.
~~~~ ~~~~~~ {email:~~~~~.~~~~~~ (at) ~~~~.com} ~~~ ~~~
{email:~~~~~~~~ (at) ~~~~ (dot) net} ~~~~~
^~~~ {email:~~~~~ at ~~~~~~ dot com} ~~~
our phone is {phone:###-###-####} from nine on
^~~~~~ ~~~ {phone:(###) ###-####}, ~~~ ~~~~
{phone:(###) ###-####}
Telephone {phone:###.###.####}.
please ring {phone:0### ### ####} soon
password: {secret:~~~~~~~~~##} ~~~~
~~~~ ~~~~~ password: {secret:~~~~~~~~~} ~~~~ ~~~
passwd = {secret:~~~~~~~##}
~~~~~, token = "{secret:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@}".
"token": "{secret:@@@@@@@@@@@@@@@@@@@@@@@@}"
api_key = "{secret:&&&&&&&&&&&&&&&&&&&&&&&&}" ~~~
~~~ secret = "{secret:@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@}" ~~~
^~~~ ~~~~~ ~~~ ~~~~~, ~~~ #### ~~~ ~~ ~~~~.
see pages ##-## and ###-### of volume #
on ####-##-## at ##:## the ~~~~ ~~~~ ~~~
the ~~~~ at ~~~~~ was ~~~, the ~~~ dot ~~~~
^~~~ ~~~. ^~~~ ~~~~ ~~~ (~~~) ~~~ ~~~~~ ###.## ~~~
version #.#.# of ~~~~ was ~~~~~ in ####
~~~~ ################ ~~~~ ~~~~
the key to the ~~~~ is in the ~~~~ of ~~~
""".strip().splitlines()


def test_exact_spans_of_held_out_sentences(monkeypatch):
    model = crf_pii.reader()
    monkeypatch.setattr(crf_pii, "LABELLED", HELD_OUT)
    right = said = true = 0
    for text, want in crf_pii.labelled_rows(seed=99):
        got = set(model.spans([text])[0])
        right, said, true = right + len(got & set(want)), said + len(got), true + len(want)
    assert true > 90 and right / said >= 0.93 and right / true >= 0.93


@pytest.mark.parametrize("secret", ["212-555-0199", "jane (at) example (dot) com", "jane.of.the.long.river.house (at) example (dot) com"])
def test_stretches_make_the_whole_text_s_likeliest_path(secret):
    model, net = crf_pii.reader(), crf_pii.field()
    texts = [" ".join([*(["river", "7"] * 300)[:at], "write to", secret, *["river", "7"] * (at % 300)]) for at in range(180, 280, 3)]
    texts += ["", "a", "river " * 255, "river 7 " * 640, secret]
    found = model.spans(texts)
    for text, got in zip(texts, found):
        tokens = crf_pii.tokenize(text)
        if not tokens:
            assert got == []
            continue
        assert "".join(crf_pii._PIECE.findall(text)) == text.rstrip()
        (labels,) = model.decode([model.codes(crf_pii._PIECE.findall(text))])
        assert labels.tolist() == net.decode([crf_pii.features(tokens)])[0]
        assert got == [s for s in got if text[s[1] : s[2]].strip() == text[s[1] : s[2]]]
        if secret in text:
            assert secret.split()[-1] not in crf_pii.mask(text, crf_pii.find([text], model)[0][1])


def test_personal_data_of_odd_rows(documents, odd):
    got = {r.doc_id: r for r in crf_pii.scan(documents(odd)).collect()}
    assert got[9].n_email == 1 and got[9].n_phone == 1 and got[1].spans == "" and got[8].n_card == 0
    assert got[9].n_spans == 2 and got[1].n_spans == 0
    assert crf_pii.scan(documents([])).count() == 0
    kept = crf_pii.redact(documents(odd))
    assert kept.columns == documents(odd).columns
    assert {r.doc_id: r.text for r in kept.collect()}[1] is None
