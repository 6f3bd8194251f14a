from glyphmill.llm import pii


def test_all_mentions_of_a_name_in_a_document():
    text = "Dr. Anna B. Schmidt wrote. Anna Schmidt came, Schmidt said. Karl Otto Weber too; WEBER left. Weberei stays, Paris stays."
    new, kinds = pii.replace(pii.Keyed(b"k"), text, {})
    names = ("Anna", "Schmidt", "Karl", "Otto", "Weber", "WEBER")
    assert all((a != b) == (a.strip(".,") in names) for a, b in zip(text.split(), new.split(), strict=True)) and kinds == ["name"] * 9
    assert "Weberei stays, Paris stays." in new and " B. " in new
    first, last = new.split()[1], new.split()[3].rstrip(".")
    assert f"{first} {last} came, {last} said" in new


def test_names_in_other_entities_stay_whole():
    text = "Mr. Paul Weber, mail Weber@e.org, and no name in Good Morning"
    got = list(pii.find(text))
    assert [e[0] for e in got] == ["name", "name", "email"] and got == sorted(got, key=lambda e: e[1])


def test_no_name_is_its_own_surrogate():
    keyed = pii.Keyed(b"glyphmill")
    for (script, gender), names in pii.NAMES.items():
        new = [keyed.name(script, gender, n.lower(), 0) for n in names]
        assert sorted(new) == sorted(n.lower() for n in names) and all(x != n.lower() for x, n in zip(new, names, strict=True))


def test_texts_that_leaked():
    keyed = pii.Keyed(b"glyphmill")
    new = pii.replace(keyed, "Dr. Anna Weber called. Anna said that Weber is fine.", {})[0]
    assert "Anna" not in new and "Weber" not in new and new.split()[1] == new.split()[4]
    for text, gone in (("My name is John Smith.", ("John", "Smith")), ("Mr. Παπαδόπουλος came", ("Παπαδόπουλος",)), ("Ms 王芳", ("王芳",)), ("Ms 王芳, 我见了王芳说", ("王芳",)), ("Mr أحمد قال", ("أحمد",)), ("at 2001:db8::8a2e:370:7334 or 2001:0db8:0000:0000:0000:8a2e:0370:7334", ("8a2e",))):
        new, kinds = pii.replace(keyed, text, {})
        assert kinds and not any(g in new for g in gone), new
    assert pii.replace(keyed, "Mr أحمد قال", {})[0].endswith(" قال") and pii.replace(keyed, "::1 at 12:30:45", {})[1] == ["ipv6"]
    a, b = (pii.replace(keyed, t, {})[0] for t in ("2001:db8::1", "2001:0db8:0000:0000:0000:0000:0000:0001"))
    assert a.startswith("2001:") and len(b) == 39


def test_whole_table_by_hand(spark):
    """Every text again by hand, with the query's key, as one table of entities."""
    import os

    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.exists(d):
        import pytest

        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pii.surrogates(docs, "glyphmill").collect()}
    keyed, draw, used = pii.Keyed(b"glyphmill"), {}, {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    every = sorted({(e[0], e[3]) for t in texts.values() if t for e in pii.find(t)})
    while True:
        met = {}
        for k, c in every:
            met.setdefault((k, pii.surrogate(keyed, k, c, draw.get((k, c), 0))), []).append((draw.get((k, c), 0), c))
        late = [(k, c) for (k, new), x in met.items() for _, c in x if c != min(x)[1] or k == "name" and c.rsplit("|", 1)[1] == new]
        if not late:
            break
        for e in late:
            draw[e] = draw.get(e, 0) + 1
    assert every and len({(k, pii.surrogate(keyed, k, c, draw.get((k, c), 0))) for k, c in every}) == len(every)
    for i, t in texts.items():
        new, kinds = pii.replace(keyed, t, draw) if t else (t, [])
        assert (got[i].text, got[i].n_entities, got[i].entity_types) == (new, len(kinds), kinds)
        for _, a, b, c in pii.find(t) if t else ():
            used.setdefault(t[a:b], c)
    assert not any(pii.surrogate(keyed, "name", c, draw.get(("name", c), 0)) == c.rsplit("|", 1)[1] for k, c in every if k == "name")
