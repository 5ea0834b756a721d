"""Translation providers over HTTP. A provider is a request format and where its answer holds the texts."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from babelyard.functions.lookups import ENTITIES

Send = Callable[[str, dict[str, str], bytes], bytes]


def post(url: str, headers: dict[str, str], body: bytes, seconds: float = 60.0) -> bytes:
    """The answer's body; an error status raises urllib.error.HTTPError."""
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return answer.read()


@dataclass
class HttpProvider:
    """Common part: one request a batch; `send` can be replaced, as tests do."""

    api_key: str
    send: Send = field(default=post, repr=False)

    def translate_batch(self, texts: list[str], target: str, source: str) -> list[str | None]:
        if not texts:
            return []
        url, headers, body = self.request(texts, target, source)
        return self.texts(json.loads(self.send(url, headers, json.dumps(body).encode())))

    def request(self, texts: list[str], target: str, source: str) -> tuple[str, dict[str, str], dict]:
        raise NotImplementedError

    def texts(self, answer: dict) -> list[str | None]:
        raise NotImplementedError


class GoogleProvider(HttpProvider):
    """Texts go as HTML, so that tags stay; entities of the answer are undone."""

    def request(self, texts, target, source):
        body = {"q": texts, "target": target, "format": "html"} | ({"source": source} if source else {})
        return f"https://translation.googleapis.com/language/translate/v2?key={self.api_key}", {}, body

    def texts(self, answer):
        out = [t["translatedText"] for t in answer["data"]["translations"]]
        for entity, sign in ENTITIES:
            out = [t.replace(entity, sign) for t in out]
        return out


class DeepLProvider(HttpProvider):
    """Texts go as XML in which variables' tags are left alone; keys of free accounts have a host of their own."""

    def request(self, texts, target, source):
        host = "api-free.deepl.com" if self.api_key.endswith(":fx") else "api.deepl.com"
        body = {"text": texts, "target_lang": target.upper(), "tag_handling": "xml", "ignore_tags": ["v"]}
        body |= {"source_lang": source.upper()} if source else {}
        return f"https://{host}/v2/translate", {"Authorization": f"DeepL-Auth-Key {self.api_key}"}, body

    def texts(self, answer):
        return [t["text"] for t in answer["translations"]]


@dataclass
class LibreProvider(HttpProvider):
    api_url: str = "https://libretranslate.com/translate"

    def request(self, texts, target, source):
        return self.api_url, {}, {"q": texts, "source": source or "auto", "target": target, "format": "html", "api_key": self.api_key}

    def texts(self, answer):
        return answer["translatedText"]
