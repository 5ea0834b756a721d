"""Requests and answers of HTTP providers, without a network."""

from __future__ import annotations

import json

from babelyard.operators.providers import DeepLProvider, GoogleProvider, LibreProvider


def fake(answer, seen):
    def send(url, headers, body):
        seen.append((url, headers, json.loads(body)))
        return json.dumps(answer).encode()

    return send


def test_google():
    seen = []
    own = GoogleProvider("KEY", fake({"data": {"translations": [{"translatedText": "l&#39;a &amp;lt;"}]}}, seen))
    assert own.translate_batch(["a"], "fr", "en") == ["l'a <"]
    assert seen[0][0].endswith("?key=KEY") and seen[0][2] == {"q": ["a"], "target": "fr", "source": "en", "format": "html"}
    assert own.translate_batch([], "fr", "en") == [] and len(seen) == 1


def test_deepl():
    seen = []
    own = DeepLProvider("KEY:fx", fake({"translations": [{"text": "x"}]}, seen))
    assert own.translate_batch(["a"], "de", "") == ["x"]
    url, headers, body = seen[0]
    assert url == "https://api-free.deepl.com/v2/translate" and headers["Authorization"] == "DeepL-Auth-Key KEY:fx"
    assert body == {"text": ["a"], "target_lang": "DE", "tag_handling": "xml", "ignore_tags": ["v"]}


def test_libre():
    seen = []
    own = LibreProvider("KEY", fake({"translatedText": ["x", "y"]}, seen), "http://localhost:5000/translate")
    assert own.translate_batch(["a", "b"], "es", "") == ["x", "y"]
    assert seen[0][0] == "http://localhost:5000/translate" and seen[0][2]["source"] == "auto"
