import hashlib
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from hexfeat.llm import licenses, quality_classifier, quality_rules, secrets

JUNK = {
    "marks": " ".join(w + "***" for w in "one two three four five six seven eight nine ten".split() * 4),
    "menu": " | ".join("Home About Contact Login Search Help Archive Tags News Shop".split() * 3),
    "shout": " ".join(w.upper() + "!!" for w in "buy this now and save a lot of money on it today here".split() * 3),
    "repeat": "again " * 80,
}
CLEAN = "The ferry left the harbour at noon. It carried mail, two horses and a small crowd of visitors.\nNobody minded the rain, since the crossing takes less than an hour and the cabin is dry."


def slow_repeats(words):
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_base_counts_against_brute_force(docs, texts):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect()), key=str)
    want = []
    for i, t in texts:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        rep = slow_repeats(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, len(words) < 20 or 100 * rep > 30 * len(words)))
    assert got == sorted(want, key=str)


def test_lines_decide(spark, empty):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([CLEAN, *JUNK.values(), CLEAN + "\nHome | About | Contact | Login | Search"])], "doc_id long, text string")
    assert {r.doc_id for r in quality_rules.quality_rules(rows).filter("kept").collect()} == {0, len(JUNK) + 1}
    assert quality_rules.quality_rules(empty).count() == 0


def test_secret_base_and_spans(docs, texts):
    def brute(t):
        out = []
        for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            if len(m[2]) >= 6:
                out.append((m.start(), 0, m.end(), "assign"))
        out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))

    cases = ["Password = 'abc123' x", "token:ab", "SECRET=\"a.b-c_d\" api_key : zzzzzz apikey=qqqqqq", "AKIA" + "Q" * 16, "AKIA1", "f" * 24, "é" + "0a" * 12 + "g", "ſecret=abcdef toKen=abcdef", "token = \"" + "ab" * 20 + '"', ""]
    for t in cases:
        base, spans = secrets.all_spans(t)
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in base) == brute(t)
        assert set(base) <= set(spans)
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id == 1:
            assert r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == ""


def test_random_strings_are_found_and_words_are_not():
    rng = random.Random(2)
    letters = string.ascii_letters + string.digits
    for alphabet, n, least in ((letters, 40, 95), (letters + "+/", 40, 95), (string.ascii_uppercase + "234567", 128, 90)):  # one case and few digits: only long ones stand out
        hits = sum(bool(secrets.all_spans("here it is: " + "".join(rng.choice(alphabet) for _ in range(n)) + " ok")[1]) for _ in range(100))
        assert hits >= least
    ordinary = ["internationalisation" * 2, "getElementByIdAndClassName2", "/usr/lib/python3/dist-packages/numpy", "OverlyLongClassNameForTestingPurposes", "2024-01-01-2024-02-02-2024", "http/path/to/some/ordinary/file", "abcdefghijklmnopqrstuvwxyz0123456789", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "snake_case_names_are_fine_here_too", "0123456789" * 3]
    assert not [t for t in ordinary if any(k == "random" for *_, k in secrets.all_spans(t)[1])]
    assert secrets.masked("a token=abcdef12 b") == "a [SECRET] b"


def test_licences(spark, docs, texts):
    model = licenses.fit(spark)
    rows = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "intro\nThis work is licensed under the GNU General Public License, version 3.\nmore"), (3, "My driver license expired."), (4, "Licensed under CC BY-NC 4.0."), (5, "Released under the MIT License.\nAll rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: (r.family, r.families) for r in licenses.scan_licenses(rows, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["apache-2.0", "gpl", "unknown", "cc-by-nc"] and got[5][1] == "mit,proprietary"
    whole = licenses.scan_licenses(docs, model)
    assert whole.count() == len(texts) and whole.filter("family <> 'unknown'").count() == 0
    assert licenses.scan_licenses(docs.filter("false"), model).count() == 0
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_classifier_takes_rows_without_or_with_one_id(spark):
    """The fit doesn't depend on ids: null ones and a single one tell good texts from junk as well, and long words are read whole."""
    good = [" ".join(f"The river {w} runs past the old mill, and {k} people walk there." for w in ("slowly", "quickly", "always")) for k in range(60)]
    junk = [" ".join(["X9#|@ 77%$ »»» |||"] * 12) + str(k) for k in range(20)]
    answers = []
    for ids in (range(80), [None] * 80, [7] * 80):
        df = spark.createDataFrame(list(zip(ids, good + junk, strict=True)), "doc_id long, text string").repartition(3)
        out = quality_classifier.score_quality(df, quality_classifier.fit(df)).groupBy("kept").count().collect()
        answers.append({r["kept"]: r["count"] for r in out})
    assert answers == [{True: 60, False: 20}] * 3
    shapes = quality_classifier.Shapes(512)
    assert shapes._place("a1" * 40 + "B") != shapes._place("a1" * 40) and shapes.vector("x" * 100_000).any() and not shapes.known


def test_quality_classifier_learns_without_labels(spark, docs, texts):
    rng = random.Random(4)
    words = CLEAN.split()
    rows = [(i, " ".join(rng.sample(words, 25)).capitalize() + ".\n" + CLEAN) for i in range(150)]
    rows += [(1000 + i, " ".join(rng.sample(t.split(), len(t.split()))) if len(set(t.split())) > 1 else t) for i in range(12) for t in JUNK.values()]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality_classifier.score_quality(df, quality_classifier.fit(df)).collect()
    right = sum(r.kept == (r.doc_id < 150) for r in out)
    assert right >= 0.97 * len(rows)
    scorer = quality_classifier.fit(docs)
    assert quality_classifier.score_quality(docs, scorer).count() == len(texts)
    none = quality_classifier.fit(docs.filter("false"))
    assert quality_classifier.score_quality(docs.filter("false"), none).count() == 0


def test_short_secrets_in_one_case_are_found():
    """Recall at 20, 32 and 40 characters for each encoding; assignments of any name are split at their =."""
    rng, digits, upper, lower = random.Random(6), string.digits, string.ascii_uppercase, string.ascii_lowercase
    for alphabet in (upper + "234567", digits + "ABCDEF", digits + "abcdef", lower + digits, upper + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_"):
        for n, least in ((20, 80), (32, 97), (40, 97)):
            hits = sum(bool(secrets.all_spans("here it is: " + "".join(rng.choice(alphabet) for _ in range(n)) + " ok")[1]) for _ in range(100))
            assert hits >= least, (alphabet, n, hits)
    key = "Q7XK2MVB5ZJW3RTP6LHD4NYC"
    assert secrets.masked(f"sessionid={key}&page=3") == "sessionid=[SECRET]&page=3"
    ordinary = ["DEFAULT_MAXIMUM_CONNECTION_TIMEOUT_2", "donaudampfschifffahrtsgesellschaft2", "MINISTERIODERELACIONESEXTERIORES24", "ACGTTGCAACGTAGCTAGCTAGGATCCA", "chapter12section04paragraph007", "version-2024-11-05-release-candidate-2", "anticonstitutionnellement1789"]
    assert not [t for t in ordinary if secrets.all_spans(t)[1]]


def test_keys_anywhere_in_a_long_run():
    """A run without blanks is scored to its end, and only what looks random in it is reported."""
    rng, letters = random.Random(7), string.ascii_letters + string.digits
    ordinary = lambda n: "/".join(rng.choice(CLEAN.replace(".", "").replace(",", "").split()) for _ in range(n))
    for head, tail in ((3000, 5), (5, 3000), (1500, 1500), (100, 100)):
        for alphabet, n in ((letters, 40), (string.ascii_uppercase + "234567", 32)):
            before, key, after = ordinary(head) + "/", "".join(rng.choice(alphabet) for _ in range(n)), "/" + ordinary(tail)
            out = secrets.masked(before + key + after)
            assert out.startswith(before[:-10]) and out.endswith(after[10:]) and out.count("[SECRET]") == 1 and key[:4] not in out and key[-4:] not in out
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    assert secrets.masked(ordinary(500) + "/" + "/x/".join(k + "/" + ordinary(50) for k in keys)).count("[SECRET]") == len(keys)
    blob = "".join(rng.choice(letters + "+/") for _ in range(20_000))
    rest = ordinary(2000)
    assert secrets.masked(blob + "/" + rest).endswith(rest[40:]) and len(secrets.masked(blob + "/" + rest)) < len(rest) + 60
    assert secrets.all_spans(ordinary(20_000))[1] == []


def test_licences_named_in_one_word_with_their_version(spark):
    model = licenses.fit(spark)
    texts = {1: ("Released under GPLv3.", "gpl"), 2: ("This library is under LGPLv3", "lgpl"), 3: ("The code is GPLv2 or later.", "gpl"), 4: ("Released under CC0 1.0", "public-domain"), 5: ("Copyrighted material. All rights reserved.", "proprietary"), 6: ("The gplain text was copyrighted by nobody.", "unknown")}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.family for r in licenses.scan_licenses(rows, model).collect()} == {i: f for i, (_, f) in texts.items()}
    tokens = spark.createDataFrame([("copyrighted",), ("gplv3",), ("cc0",)], "t string").withColumn("tokens", licenses.words(F.col("t")))
    assert tokens.select(licenses.grams("tokens").alias("g")).filter("size(g) = 0").count() == 0


def test_a_run_is_treated_alike_at_every_length():
    """A key behind a path: the same characters are masked whether the run has 60 or 5,000 of them."""
    rng = random.Random(11)
    words = CLEAN.replace(".", "").replace(",", "").split()
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    for n in (20, 100, 214, 215, 216, 217, 300, 5000):
        path = ""
        while len(path) < n:
            path += rng.choice(words) + "/"
        path = path[-n:-1].strip("/") + "/"
        assert secrets.run_tests(path + key)[-1][:2] == (len(path), len(path) + 40), n
        assert secrets.masked(path + key) == path + "[SECRET]"


def test_battery_at_24_characters_and_what_it_leaves_out():
    """Recall of 24 characters in each encoding, of one case at 64; words joined in any way and numbers are text."""
    rng, digits, upper, lower = random.Random(12), string.digits, string.ascii_uppercase, string.ascii_lowercase
    found = lambda alphabet, n: sum(bool(secrets.all_spans("".join(rng.choice(alphabet) for _ in range(n)))[1]) for _ in range(300)) / 300
    for alphabet in (upper + "234567", digits + "ABCDEF", lower + digits, upper + digits, upper + lower + digits, upper + lower + digits + "+/"):
        assert found(alphabet, 24) >= 0.85, alphabet
    assert found(lower, 64) >= 0.95 and found(upper, 64) >= 0.95
    assert secrets.text_p_value("".join(rng.choice(digits) for _ in range(64))) is None  # the base's hex pattern has these
    words = re.findall("[A-Za-z]+", CLEAN)
    for sep in ("", "_", "/", "-"):
        for case in (str.lower, str.upper, str.capitalize):
            assert not [t for _ in range(100) if secrets.all_spans(t := sep.join(case(rng.choice(words)) for _ in range(rng.randint(5, 30))))[1]]


def test_secret_query_against_brute_force(spark, docs, texts, empty):
    """Spans, counts and digests of the query are those of its rows read one by one; an empty table has none."""
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.scan_secrets(docs).collect()}
    want = set()
    for i, t in texts:
        base, spans = secrets.all_spans(t or "")
        kinds = Counter(k for *_, k in base)
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        want.add((i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in spans)))
    assert got == want
    assert secrets.scan_secrets(empty).count() == 0


#: Family and notices that the training set does not hold.
UNSEEN = {
    "mit": ["This software is distributed under the MIT license", "Code is available under the terms of the MIT License.", "Der Quelltext steht unter der MIT-Lizenz.", "El código se publica bajo licencia MIT.", "Le code est publié sous licence MIT."],
    "apache-2.0": ["The code is licensed under the Apache License 2.0", "Distributed under the Apache License, Version 2.0", "El software está bajo la licencia Apache 2.0.", "Logiciel sous licence Apache 2.0.", "Der Code ist unter der Apache-Lizenz 2.0 verfügbar."],
    "gpl": ["# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.", "The tool is licensed under the GNU GPL version 3.", "Diese Software steht unter der GNU General Public License.", "Distributed under the terms of the GNU General Public License v2", "Programa publicado bajo la licencia GNU GPL."],
    "lgpl": ["This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "The library is licensed under the GNU Lesser General Public License.", "Distributed under the LGPL.", "Biblioteca publicada bajo la licencia LGPL."],
    "agpl": ["The server is licensed under the GNU Affero General Public License.", "Distributed under the AGPL v3.", "you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3"],
    "bsd": ["This module is distributed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "Der Code steht unter der BSD-Lizenz.", "Logiciel sous licence BSD."],
    "mpl": ["This file is subject to the terms of the Mozilla Public License.", "Code under the Mozilla Public License, version 2.0", "Code sous la licence publique Mozilla."],
    "isc": ["This package is licensed under the ISC license.", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that"],
    "cc-by": ["The dataset is licensed under CC BY 4.0", "This article is licensed under a Creative Commons Attribution 4.0 International License", "La obra está bajo una licencia Creative Commons Atribución 4.0."],
    "cc-by-sa": ["Content is available under CC BY-SA 4.0", "The article is licensed under a Creative Commons Attribution-ShareAlike License.", "Texte sous licence CC BY-SA 4.0."],
    "cc-by-nc": ["The images are shared under CC BY-NC 4.0", "The course is licensed under a Creative Commons Attribution-NonCommercial license."],
    "public-domain": ["The photograph has been released into the public domain.", "Das Bild ist gemeinfrei.", "Esta imagen está en el dominio público.", "Cette image est dans le domaine public."],
    "proprietary": ["Copyright 2019 Example Ltd. All rights reserved.", "(c) 2021 Beispiel GmbH. Alle Rechte vorbehalten.", "© 2018 Ejemplo S.A. Todos los derechos reservados.", "© 2018 Exemple. Tous droits réservés.", "This file is proprietary and confidential."],
    "unknown": ["The pub had its license renewed in spring.", "He asked for permission to build a shed.", "A creative mind needs rest.", "The reserved seats were taken by noon.", "She renewed the domain for another year.", "The apache guide knew the canyon.", "The warranty had run out.", "The author took some poetic license with the dates.", "A license plate was found near the road.", "Die Lizenz für das Lokal wurde verlängert.", "Er bekam die Lizenz zum Angeln.", "La licencia de obras tardó dos años.", "Pidieron permiso al ayuntamiento.", "Il a obtenu sa licence en droit.", "Le propriétaire a vendu le domaine.", "La chambre était réservée.", "The copyright office is closed on Sundays.", "Wildebeest, or gnu, cross the river in June.", "The city licensed two hundred taxis.", "Two families fought over the domain of the king.", "A licensing exam is held every June.", "The students of MIT met in Boston.", "The park warrants a visit.", "The manufacturer's warranty is void if the seal is broken."],
}


def test_licences_of_unseen_paragraphs(spark):
    """Wrapped, in four languages, of neighbouring families: precision and recall over paragraphs that weren't fitted."""
    known = {t for texts in licenses.NOTICES.values() for t in texts}
    cases = [(f, t) for f, texts in UNSEEN.items() for t in texts]
    assert not known & {t for _, t in cases}
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.scan_licenses(rows, licenses.fit(spark)).collect()}
    named = [(f, got[i], t) for i, (f, t) in enumerate(cases) if got[i] != "unknown"]
    wrong = [x for x in named if x[0] != x[1]]
    right, notices = len(named) - len(wrong), sum(f != "unknown" for f, _ in cases)
    missed = [c for i, c in enumerate(cases) if c[0] != got[i] == "unknown"]
    assert right >= 0.97 * len(named) and right >= 0.8 * notices, (right, len(named), notices, wrong, missed)
    assert "lgpl" == got[cases.index(("lgpl", UNSEEN["lgpl"][0]))] and "gpl" == got[cases.index(("gpl", UNSEEN["gpl"][0]))]
