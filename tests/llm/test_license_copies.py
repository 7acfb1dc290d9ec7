from tideline.llm import licenses


def test_adjacent_copies_with_template_words_around():
    copy = "Licensed under the Apache License, Version 2.0. "
    for text in (f"under the terms: {copy}{copy}See the license", copy * 3, f"the license {copy * 4} under version"):
        found = {name: coverage for name, coverage, _, _ in licenses.Scanner(licenses.TEMPLATES).scan(text)}
        assert found.get("Apache-2.0-notice") == 1.0, text
