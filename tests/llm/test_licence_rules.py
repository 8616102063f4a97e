"""Licence scans: known texts, rule order, and what must not be found."""

import pytest

from basketflow.llm.licence_rules import MARKERS, RULES, SENTENCES, licence_scan

MIT = """/*
 * Permission is hereby granted, free of charge, to any person
 * obtaining a copy of this software. The above
 * copyright notice and this permission notice shall be included in all
 * copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
 * IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.
 */"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
# Software distributed under the License is distributed on an "AS IS" BASIS."""
CASES = [
    ("Some words here\nReleased under the MIT License.\nMore words", ["MIT"], 0),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], 0),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], 0),
    ("a | b | c\nLicensed under the Apache License, Version 2.0.\n\nAll rights reserved.", ["Apache-2.0", "Proprietary"], 0),
    (MIT, ["MIT"], 0),
    (APACHE, ["Apache-2.0"], 0),
    ("Copyright (c) 2020 Somebody.\nAll rights reserved.", ["Proprietary"], 0),
    ("Copyright (c) 2020 Somebody.\n\n" + MIT, ["MIT"], 1),
    ("MIT License\n\nCopyright 2021 X", ["MIT"], 1),
    ("word " * 50_000 + "\nReleased under the MIT License. " + "word " * 50_000, ["MIT"], 0),
]
SCHEMA = "doc_id long, text string, licences string, left string"


def test_known_texts(spark):
    rows = [(i, t, "x", "y") for i, (t, *_) in enumerate(CASES)]
    found = licence_scan(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "sentence_ids", "licences", "unmatched"]
    got = {r.doc_id: (r.licences, r.unmatched) for r in found.collect()}
    assert got == {i: (names, left) for i, (_, names, left) in enumerate(CASES)}


def test_nothing_known(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "A licence to print money. He gave permission.", "x", "y"), (4, "mit dem Zug", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert licence_scan(docs).collect() == [] and licence_scan(docs.where("false")).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "All rights reserved.", "x", "y"), (7, "All rights reserved", "x", "y"), (7, "All rights reserved", "x", "y")]
    assert sorted(str(r.doc_id) for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()) == ["7", "7", "None"]


def test_tables_agree():
    names = [n for n, _ in SENTENCES]
    assert len(names) == len(set(names))
    assert all(i in names for _, ids in RULES for i in ids)
    for name, pattern in SENTENCES:
        assert any(m in pattern for m in MARKERS), name


def test_no_python_and_no_shuffle(spark):
    plan = licence_scan(spark.createDataFrame([(1, "x", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))


# One text per entry of SENTENCES, as licences word it.
TEXTS = {
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MIT-reference": "Released under the terms of the MIT License",
    "MIT-title": "The MIT License",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions",
    "BSD-endorse": "Neither the name of X nor the names of its contributors may be used to endorse products without specific prior written permission",
    "BSD-reference": "Distributed under the 3-Clause BSD License",
    "Apache-2.0-reference": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "Apache-2.0-obtain": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-compliance": "you may not use this file except in compliance with the License",
    "Apache-2.0-basis": 'Software distributed under the License is distributed on an "AS IS" BASIS',
    "GPL-3-reference": "Licensed under the GNU General Public License, version 3",
    "GPL-2-reference": "Licensed under the GNU General Public License v2",
    "GPL-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published",
    "GPL-2-later": "either version 2 of the License, or (at your option) any later version",
    "GPL-3-later": "either version 3 of the License, or (at your option) any later version",
    "GPL-see": "See the GNU General Public License for more details",
    "LGPL-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "MPL-2.0-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-reference": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-SA-reference": "Licensed under Creative Commons BY-NC-SA 4.0",
    "CC-BY-SA-reference": "Licensed under CC BY-SA 4.0",
    "CC-BY-reference": "Licensed under CC BY 4.0",
    "CC0-dedication": "The author has dedicated the work to the public domain",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "AS-IS": 'The software is provided "as is", without warranty of any kind',
    "NO-WARRANTY": "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY",
    "NO-LIABILITY": "In no event shall the authors be liable for any claim",
    "RIGHTS-RESERVED": "All rights reserved",
    "COPYRIGHT": "Copyright (c) 2020 Somebody",
}


def test_every_sentence_is_found(spark):
    assert list(TEXTS) == [n for n, _ in SENTENCES]
    rows = [(i, f"Some words. More words\n\n{t}. The end.", "x", "y") for i, t in enumerate(TEXTS.values())]
    got = {r.doc_id: r.sentence_ids for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: [name] for i, name in enumerate(TEXTS)}


def test_every_rule_is_reached(spark):
    rows = [(i, "\n".join(f"# {TEXTS[x]}.".replace("\n", "\n# ") for x in ids), "x", "y") for i, (_, ids) in enumerate(RULES)]
    got = {r.doc_id: (r.sentence_ids, r.licences, r.unmatched) for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (list(ids), [name], 0) for i, (name, ids) in enumerate(RULES)}


def test_signs_elsewhere_still_end_sentences(spark):
    rows = [(1, "See part v. 2 and more; the MIT License: no other. The MIT License: all rights reserved", "x", "y")]
    assert licence_scan(spark.createDataFrame(rows, SCHEMA)).first().sentence_ids == ["MIT-title", "MIT-title", "RIGHTS-RESERVED"]
