"""Notices and bodies as files carry them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.llm import licenses

GNU = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU {} as published by
    the Free Software Foundation, either version {} of the License, or
    (at your option) any later version."""
MIT = """Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0"""
PROSE = "They came to terms with it under the old oak of the foundation, as published in the general press by the public, free of charge and software-minded people of any version."


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (GNU.format("General Public License", "3"), ["gpl", "gpl-3.0"]),
        (GNU.format("General Public License", "2"), ["gpl", "gpl-2.0"]),
        (GNU.format("Lesser General Public License", "2.1"), ["lgpl", "lgpl-2.1"]),
        (GNU.format("Affero General Public License", "3"), ["agpl", "agpl-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["cc-by-nc-4.0"]),
        ("Licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", ["cc-by-sa-3.0"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by", "cc-by-nc-sa-4.0"]),
        (MIT, ["mit"]),
        (BSD, ["bsd", "bsd-3-clause"]),
        (APACHE, ["apache", "apache-2.0"]),
        (MIT.replace("permit persons", "allow persons") + "\n" + "filler " * 3000 + "\n" + APACHE, ["apache", "apache-2.0", "mit"]),
        (PROSE, []),
    ],
)
def test_texts(spark, text, labels):
    row = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.labels == labels
    assert (row.score == 0) == (not row.spans and not labels) or row.score >= 0.75


def test_very_many_places(spark):
    n = 4000
    text = ("Released under the MIT License. " * n) + "the mit license " * n
    row = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("labels", F.size("spans").alias("n"), "n_base").first()
    assert row.labels == ["mit"] and row.n_base == 2 * n and row.n >= n
