"""Licences told from blocks of wrapped lines, one-line headers, SPDX forms and whole licence files."""

import textwrap

from tessera.llm import licenses

GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
ISC = " ".join(licenses._ISC)


def wrapped(text, width=66, prefix=""):
    return "\n".join(prefix + x for x in textwrap.wrap(text, width))


def test_wrapped_notices_and_headers(spark):
    prose = "The old mill by the river\nwas built by three brothers\nwho had come from far away.\n"
    want = {
        "/a/gpl": (wrapped(GNU.format("program", ""), prefix="# ") + "\n\nx = 1\n", "GPL-3.0"),
        "/b/lgpl": (wrapped(GNU.format("library", "Lesser ")), "LGPL-3.0"),
        "/c/apache": ("Copyright (c) 2020 Foo Bar. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "/d/spdx": ("// SPDX-License-Identifier: BSD-3-Clause\n\nint main;", "BSD-3-Clause"),
        "/e/later": ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        "/f/LICENSE": ("MIT License\n\nCopyright (c) 2021 Foo\n\n" + "\n\n".join(wrapped(t) for t in licenses._MIT), "MIT"),
        "/g/COPYING": ("Copyright (c) 2019, Bar\n\n" + wrapped(ISC), "ISC"),
        "/h/bsd2": ("\n".join(wrapped(t) for t in (licenses._BSD[0], licenses._BSD[2])), "BSD-2-Clause"),
        "/i/bsd3": ("\n".join(wrapped(t) for t in licenses._BSD), "BSD-3-Clause"),
        "/j/prose": (prose + "\n" + prose, None),
        "/k/other": ("SPDX-License-Identifier: Foo-Bar", None),
    }
    files = spark.createDataFrame([(p, t) for p, (t, _) in want.items()], "path string, text string")
    got = {r.path: r for r in licenses.scan(files).collect()}
    assert {p: r.license for p, r in got.items()} == {p: x for p, (_, x) in want.items()}
    # a block speaks for all its lines, and a whole licence file for all of its own
    assert got["/a/gpl"].licensed == got["/a/gpl"].lines - 1 and got["/b/lgpl"].licensed == got["/b/lgpl"].lines
