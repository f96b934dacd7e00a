"""Standard notices verbatim, wrapped as they are published."""

from __future__ import annotations

import pytest

from cohortspark.llm import licenses

BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.
"""
LGPL21 = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
"""
CASES = [
    (BSD2, "BSD-2-Clause"),
    (BSD3, "BSD-3-Clause"),
    (GPL3, "GPL-3.0-or-later"),
    (" ".join(GPL3.split()), "GPL-3.0-or-later"),
    (GPL2, "GPL-2.0-or-later"),
    ("".join(f"// {line}\r\n" for line in GPL2.splitlines()), "GPL-2.0-or-later"),
    (LGPL21, "LGPL-2.1-or-later"),
    (ISC, "ISC"),
    (MPL, "MPL-2.0"),
    ("prose without a stop\nLicensed under CC BY-NC 4.0\nand more of it", "CC-BY-NC-4.0"),
]


@pytest.mark.parametrize("text, found", CASES)
def test_wrapped_notices(spark, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licenses.scanned(docs).first()
    assert (row.licenses, row.unused) == (found, "")
