from __future__ import annotations

import pytest

from cohortspark.llm import licenses
from helpers import no_documents, odd_documents, odd_rows

BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:\nRedistributions of source code must retain the above copyright "
    "notice, this list.\nRedistributions in binary form must reproduce the above copyright notice."
)
CASES = [
    ("Text.\nReleased under the MIT License.", "MitRef", "MIT", ""),
    (BSD, "BsdIntro,BsdSource,BsdBinary", "BSD-2-Clause", ""),
    (BSD + "\nNeither the name of X nor Y.", "BsdIntro,BsdSource,BsdBinary,BsdName", "BSD-3-Clause", ""),
    (
        "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.",
        "Gpl3Ref,CcByNc4",
        "GPL-3.0-only,CC-BY-NC-4.0",
        "",
    ),
    ("Neither the name of X.", "BsdName", "", "BsdName"),
    ("Released under the MIT License; released under the mit  licence.", "MitRef", "MIT", ""),
    ("Licensed under CC BY 4.0!\nLicensed under CC BY 4.0", "CcBy4,CcBy4", "CC-BY-4.0", ""),
    ("The licensed pilot said: permission denied.", "", "", ""),
]


@pytest.mark.parametrize("text, ids, found, unused", CASES)
def test_cases(spark, text, ids, found, unused):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(licenses.scanned(docs).first()) == (1, ids, found, unused)


def test_odd_rows(spark):
    assert licenses.scanned(odd_documents(spark)).filter("sentence_ids = ''").count() == len(odd_rows())
    assert licenses.scanned(no_documents(spark)).count() == 0
