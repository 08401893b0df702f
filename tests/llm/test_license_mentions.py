"""Identifiers in running text, and sentences out of licence texts."""

from __future__ import annotations

import re

import pytest

from framelake.llm import license_scan as L


def labels(text):
    return [d["label"] for d in L.scan_text(text)[2]]


@pytest.mark.parametrize(("label", "words"), [(a, e) for a, _, e in L.IDENTIFIERS if " " in e])
def test_identifiers_in_passing(label, words):
    """Whether a sentence says under, licence, licensed or nothing beside it."""
    plain = re.sub(r"\(\?:[^)]*\)\?", "", words)
    for text in (f"we use {plain} here", f"under {plain} since May", f"under the {plain}.", f"license {plain}", f"{plain}-licensed", plain.upper()):
        assert label in labels(text), text
    assert label not in labels(" ".join(f"{w} x" for w in plain.split()))


def test_mentions_of_the_verdict():
    assert labels("we use gpl 3.0 here") == ["gpl-3.0"]
    assert labels("a CC BY-SA 4.0 image") == ["cc-by-sa-4.0"]


@pytest.mark.parametrize(
    ("label", "text"),
    [
        ("apache-2.0", 'You may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
        ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        ("gpl", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
        ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
        ("unlicense", "This is free and unencumbered software released into the public domain."),
        ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
        ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("cc-by-sa-3.0", "licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
        ("ofl", "No Modified Version of the Font Software may use the Reserved Font Name(s) unless"),
        ("proprietary", "Reproduction of this publication is strictly prohibited."),
        ("eula", "END USER LICENSE AGREEMENT"),
    ],
)
def test_sentences(label, text):
    assert label in labels(text)


def test_plain_prose_has_no_labels():
    assert labels("The package was sent with care, the library closed early, and the people all agreed that the end of the work was near.") == []
