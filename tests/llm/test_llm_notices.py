"""Notices beside other words and whole licence files."""

import pytest

from stepgrove.llm import licenses

MIT = licenses.FULL["MIT"][0]
NOTICES = {
    "Copyright (c) 2020 Jane Example and the Foo project contributors.\nReleased under the MIT License.": "MIT",
    "The parser was written in one summer. Released under the MIT License. Patches are welcome here.": "MIT",
    " ".join(["plain"] * 30) + " Released under the MIT License. " + " ".join(["words"] * 30): "MIT",
    "# SPDX-License-Identifier: MIT\nimport os": "MIT",
    "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
    "/* SPDX-License-Identifier: BSD-2-Clause */": "BSD-2-Clause",
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "Some tool. Licensed under the ISC License. It has no users.": "ISC",
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions\nare met": "BSD-3-Clause",
    "Released under the Foo License.": None,
    "he said that the licence of the house was lost": None,
}


@pytest.mark.parametrize("text", NOTICES)
def test_notices_beside_other_words(spark, text):
    found = licenses.own_licences(spark.createDataFrame([("x/a.txt", text)], "path string, text string")).first()
    assert found.licence == NOTICES[text]


def test_whole_licence_files(spark):
    rows = [(f"{name}/a.txt", f"Copyright (c) 2021 Jane Example\n\n{texts[0]}") for name, texts in licenses.FULL.items()]
    rows += [(f"{name}/b.txt", f"   {texts[0]}\n" + "terms and conditions of the license " * 200) for name, texts in licenses.TITLES.items() if name not in licenses.FULL]
    rows += [(f"{p.split('/')[0]}/sub/c.py", "x = 1") for p, _ in rows]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert all(r.effective == r.path.split("/")[0] for r in got)
