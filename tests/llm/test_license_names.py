"""Sentences that many licenses share bring no label of one of them."""

from dockwatch.llm import licenses

TEXTS = {
    "licensed under the GNU LGPL": "",
    "released under the terms of our shop": "",
    "licensed under the GPL, see the MIT license for the rest": "",
    "This work is licensed under a trade license": "",
    "This Source Code Form is subject to the terms of the Eclipse Public License": "",
    "Licensed under the Educational Community License, Version 2.0 (the License); you may not use this file "
    "except in compliance with the License": "",
    "licensed under the MIT license": "mit",
    "licensed under the Apache license": "apache",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use that file except in "
    "compliance with the License": "apache",
    "Apache License Version 2.0: the License. You really may not use this file except in compliance with the "
    "License": "apache",
    "the license is here: Apache License Version 2.0, the License you, the license, may not use this file except in "
    "compliance with the License": "apache",
    "this source code form is subject to terms of the Mozilla Public License": "mpl",
}


def test_labels_need_the_name(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    for i, want in enumerate(TEXTS.values()):
        assert got[i][0] == want
        assert (got[i][1] > 0) == bool(want)
