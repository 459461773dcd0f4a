import itertools
import re
from re import _constants as c
from re import _parser

from pyspark.sql import functions as F

from graphloom.llm import licenses


def _samples(parsed) -> list[str]:
    """A text for each way through the alternatives and optional parts of a pattern."""
    parts = []
    for op, arg in parsed:
        if op is c.LITERAL:
            parts.append([chr(arg)])
        elif op is c.NOT_LITERAL:
            parts.append(["x"])
        elif op is c.IN:
            kind, value = arg[0]
            parts.append([chr(value if kind is c.LITERAL else value[0])])
        elif op is c.BRANCH:
            parts.append([x for way in arg[1] for x in _samples(way)])
        elif op is c.SUBPATTERN:
            parts.append(_samples(arg[3]))
        elif op is c.MAX_REPEAT:
            parts.append([""] * (arg[0] == 0) + _samples(arg[2]))
        else:
            raise AssertionError(op)
    return ["".join(x) for x in itertools.product(*parts)]


def test_every_alternative_has_its_keyword():
    for label, keyword, pattern, _ in licenses.NAMES:
        for text in _samples(_parser.parse(pattern)):
            assert re.fullmatch(pattern, text)
            assert f" {keyword}" in f" {text}", (label, keyword, text)


def test_every_signature_has_its_keyword():
    for label, keyword, pattern in licenses.SIGNATURES:
        for text in _samples(_parser.parse(pattern)):
            assert f" {keyword}" in f" {text}", (label, keyword, text)


def _labels(spark, texts: list[str]) -> list[set[str]]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels) for r in licenses.scan_licenses(docs).select("doc_id", F.transform("found", lambda d: d["label"]).alias("labels")).collect()}
    return [got[k] for k in range(len(texts))]


def test_names_that_stand_without_another_rules_keyword(spark):
    texts = ["Released under the FreeBSD License.", "It is under Open RAIL-M terms.", "GNU Library General Public rules apply."]
    assert _labels(spark, texts) == [{"bsd-2-clause"}, {"openrail"}, {"lgpl"}]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse products."
END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
GPL = """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version."""


def test_whole_texts_without_a_name(spark):
    assert _labels(spark, [MIT, ISC, BSD2 + END, BSD3 + END, GPL]) == [{"mit"}, {"isc"}, {"bsd", "bsd-2-clause"}, {"bsd", "bsd-3-clause"}, {"gpl-3.0"}]


def test_headers_and_notices(spark):
    texts = {
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': {"apache-2.0"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"cc-by-nc", "cc-by-nc-4.0"},
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY": {"gpl"},
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": {"gpl-2.0"},
        "Copyright 1999 Some Firm. All rights reserved.": {"all-rights-reserved"},
        "You can redistribute it and/or modify it under the same terms as Perl itself.": {"perl"},
    }
    assert _labels(spark, list(texts)) == list(texts.values())


def test_plain_mentions_are_no_licenses(spark):
    texts = ["The study was published by proprietary firms.", "Made available by the Python community.", "An artistic mind under pressure.", "He was released by MIT.", "a proprietary format", "ruby red, published under ruby lights"]
    assert _labels(spark, texts) == [set()] * len(texts)
    assert _labels(spark, ["It comes under a proprietary license.", "Released under the Ruby license."]) == [{"proprietary"}, {"ruby"}]


def test_rules_are_many_and_ordered():
    rules = licenses.rules()
    assert len(rules) > 450 and len(licenses.SIGNATURES) > 100
    assert [r.priority for r in rules] == sorted(r.priority for r in rules) and len({r.pattern for r in rules}) == len(rules)
