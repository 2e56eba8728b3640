"""What is sent to translation services and read from their replies; sending is left to the user.

A style is the shape that a family of services shares. Bodies and replies are plain dictionaries.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

# The addresses of each style below an API's root.
PATHS = {"chat": "/v1/chat/completions", "messages": "/v1/messages", "contents": "/v1beta/models/{model}:generateContent", "options": "/v1/chat/completions", "form": "/v2/translate", "list": "/v1/translator"}


def messages(system: str | None, user: str, context: Sequence[tuple[str, str]] = ()) -> list[dict[str, str]]:
    """A conversation: the instruction, earlier pairs of texts and translations, and the text."""
    head = [{"role": "system", "content": system}] if system else []
    pairs = [m for a, b in context for m in ({"role": "user", "content": a}, {"role": "assistant", "content": b})]
    return [*head, *pairs, {"role": "user", "content": user}]


def filled(template: str, text: str, language: str) -> str:
    """A prompt with its places filled; other braces stay."""
    return template.replace("{language}", language).replace("{crlf}", "\n").replace("{text}", text)


def body(style: str, model: str, text: str, language: str, prompt: dict[str, str] | None = None, context: Sequence[tuple[str, str]] = (), temperature: float | None = None, schema: dict | None = None, source: str = "auto", terms: dict[str, str] | None = None, extra: dict | None = None) -> dict:
    """The request for one text."""
    prompt = prompt or {"user": "Translate into {language}:{crlf}{crlf}{text}"}
    user = filled(prompt["user"], text, language)
    system = filled(prompt["system"], "", language) if prompt.get("system") else None
    out: dict
    match style:
        case "chat":
            out = {"model": model, "messages": messages(system, user, context)}
            if schema:
                out["response_format"] = {"type": "json_schema", "json_schema": schema}
        case "messages":
            out = {"model": model, "max_tokens": 4096, "messages": messages(None, user, context)} | ({"system": system} if system else {})
        case "contents":
            turns = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in messages(None, user, context)]
            out = {"contents": turns} | ({"systemInstruction": {"parts": [{"text": system}]}} if system else {})
            if temperature is not None:
                out["generationConfig"] = {"temperature": temperature}
        case "options":
            settings = {"source_lang": source, "target_lang": language} | ({"terms": [{"source": a, "target": b} for a, b in terms.items()]} if terms else {})
            out = {"model": model, "messages": messages(None, text), "translation_options": settings}
        case "form":
            out = {"text": [text], "target_lang": language.upper()} | ({} if source == "auto" else {"source_lang": source.upper()})
        case "list":
            out = {"source": text.split("\n"), "trans_type": f"{source}2{language}", "detect": source == "auto"}
        case _:
            raise ValueError(f"no style {style}")
    if temperature is not None and style in ("chat", "messages"):
        out["temperature"] = temperature
    return out | (extra or {})


def reply_text(style: str, reply: dict) -> str:
    """The text of a reply; fails on one that was refused, cut off or has another shape."""
    try:
        match style:
            case "chat" | "options":
                choice = reply["choices"][0]
                if choice["message"].get("refusal"):
                    raise ValueError(f"refused: {choice['message']['refusal']}")
                if choice.get("finish_reason") == "length":
                    raise ValueError("cut off")
                return choice["message"]["content"]
            case "messages":
                if reply.get("stop_reason") == "max_tokens":
                    raise ValueError("cut off")
                return "".join(p["text"] for p in reply["content"] if p.get("type") == "text")
            case "contents":
                return "".join(p.get("text", "") for p in reply["candidates"][0]["content"]["parts"])
            case "form":
                return reply["translations"][0]["text"]
            case "list":
                return "\n".join(reply["target"])
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError(f"unexpected reply: {json.dumps(reply)[:200]}") from e
    raise ValueError(f"no style {style}")


def batch_line(custom_id: str, path: str, request: dict) -> str:
    """A line of a file for a batch service."""
    return json.dumps({"custom_id": custom_id, "method": "POST", "url": path, "body": request}, ensure_ascii=False)
