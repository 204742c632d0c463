import random
import textwrap

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import license_scan as ls


def test_scan(spark):
    rng = random.Random(3)
    plain = lambda n: " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts, want = [], []
    for name, own in ls.TEMPLATES.items():
        for t in own:
            texts.append(f"{plain(80)}\n{t.upper()}.\n{plain(50)}")
            want.append({name})
    texts += [plain(rng.randint(1, 300)) for _ in range(60)] + [None, "", "the license of a public man, version", plain(2000) + " Released under the MIT License, " + plain(100)]
    want += [set()] * 63 + [{"MIT"}]
    texts.append(texts[0] + "\n" + "Released under the MIT License.")
    want.append({"AGPL", "MIT"})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, families string")
    out = ls.scan(spark, df).collect()
    assert len(out) == len(texts) + 1
    right = sum(set(r.families) == want[r.doc_id] for r in out)
    assert right >= len(out) - 2
    assert all((r.score is None) == (not r.families) for r in out)
    assert ls.scan(spark, df.limit(0)).count() == 0


def test_common_part():
    assert ls.common_part([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 0.75


def test_bare_line_of_reserved_rights(spark):
    rng = random.Random(5)
    plain = lambda n: " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = ["All rights reserved.", f"{plain(80)}\nAll rights reserved.\n{plain(50)}", f"{plain(80)}\nAll rights reserved.", "all the rights that were reserved", "reserved rights, all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.families for r in ls.scan(spark, df).orderBy("doc_id").collect()] == [["proprietary"]] * 3 + [[], []]


NOTICES = {
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def test_wrapped_notices(spark):
    rng = random.Random(7)
    plain = lambda n: " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts, want = [], []
    for name, notice in NOTICES.items():
        lines = textwrap.wrap(notice, 72)
        texts += [f"{plain(60)}\n\n" + "\n".join(lines) + f"\n\n{plain(60)}", "/*\n" + "\n".join(" * " + x for x in lines) + "\n */\n" + plain(60), "\r\n".join("# " + x for x in lines)]
        want += [[name]] * 3
    for name, own in ls.TEMPLATES.items():
        for t in own:
            if len(t) > 40:
                texts.append(plain(30) + "\n" + "\n".join(textwrap.wrap(t, len(t) // 2 + 6)) + "\n" + plain(5))
                want.append([name])
    texts += ["\n".join(textwrap.wrap(plain(300), 72)) for _ in range(20)] + ["Released under the\n\nMIT License", "Released under the"]
    want += [[]] * 22
    texts.append("MIT License")  # follows the row above in its block
    want.append([])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = ls.scan(spark, df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.families) for r in out if r.families != want[r.doc_id]] == []


#: The MIT licence as it stands in files.
MIT_TEXT = """MIT License

Copyright (c) 2024 A. Nyone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD_TEXT = """Copyright 2024 A. Nyone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_licence_files_and_layout(spark):
    rng = random.Random(9)
    plain = lambda n: " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [MIT_TEXT, BSD_TEXT, f"{plain(90)}\n\n{MIT_TEXT}\n{plain(40)}", MIT_TEXT + "\n" + BSD_TEXT] + [plain(80) for _ in range(40)]
    want = [["MIT"], ["BSD"], ["MIT"], ["BSD", "MIT"]] + [[]] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = ls.scan(spark, df.repartition(7)).orderBy("doc_id").collect()
    assert [r.families for r in out] == want
    assert ls.scan(spark, df.coalesce(1)).orderBy("doc_id").collect() == out  # the same model however the rows lie


def naive_scan(model, text):
    """Families of a text window by window: no upper bound, no blocks, no vectors over several windows."""
    from tesserae.llm.common import NON_ALNUM

    def words(t):
        return [w for w in "".join(c.lower() if c < "\x80" and c.isalnum() or c >= "\x80" else " " for c in t).split(" ") if w]

    found = set()
    for part in [*text.split("\n"), *paragraphs_of(text)]:
        w = words(part)
        assert NON_ALNUM[32]
        cut = [w[i : i + ls.PIECE] for i in range(0, len(w), ls.PIECE)]
        for k in range(max(1, len(cut) - 1)):
            window = sum(cut[k : k + 2], [])
            if not window:
                continue
            h = ls.words_of(" ".join(window))
            f, c = np.unique(ls.features(h), return_counts=True)
            logits = ((ls.SCALE * c / c.sum()) @ model.weights[f] + model.bias) / model.temperature
            p = np.exp(logits - logits.max())
            p /= p.sum()
            if 1 - p[-1] < max(model.least, 0.5):
                continue
            best = int(p[:-1].argmax())
            if max(ls.similarity(t, h.astype(np.int64).tolist()) for t in model.templates[best]) >= ls.CONFIRM:
                found.add(model.names[best])
    return sorted(found)


def paragraphs_of(text):
    out = [[]]
    for line in text.split("\n"):
        if any(c.isalnum() or c >= "\x80" for c in line):
            out[-1].append(line)
        else:
            out.append([])
    return ["\n".join(x) for x in out if len(x) > 1]


def test_query_against_brute_force(spark):
    from tesserae.llm.common import table
    from tesserae.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = ls.train(ls.unknown_paragraphs(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))))
    out = {r.doc_id: r.families for r in QUERIES["op9_license_scans"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(out) == len(rows) and any(out.values())
    wrong = [(r.doc_id, out[r.doc_id], x) for r in rows if (x := ",".join(naive_scan(model, r.text or ""))) != out[r.doc_id]]
    assert wrong == []
