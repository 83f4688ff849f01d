"""Language models that may be asked for a column's target, each by its own public client library.

A provider takes a prompt and gives the text of the reply. The libraries are optional; keys come from where each library looks for them.
"""

from __future__ import annotations

from collections.abc import Callable

from ..config import ConfigError, DomainConfig
from .mapping import Provider


def _claude(llm: dict, model: str) -> Provider:
    import anthropic

    client = anthropic.Anthropic(timeout=llm.get("timeout_seconds", 30), max_retries=0)

    def ask(prompt: str) -> str:
        said = client.messages.create(model=model, max_tokens=llm.get("max_tokens", 1000), temperature=llm.get("temperature", 0), messages=[{"role": "user", "content": prompt}])
        return "".join(part.text for part in said.content)

    return ask


def _openai(llm: dict, model: str) -> Provider:
    import openai

    client = openai.OpenAI(timeout=llm.get("timeout_seconds", 30), max_retries=0)

    def ask(prompt: str) -> str:
        said = client.chat.completions.create(model=model, messages=[{"role": "user", "content": prompt}], response_format={"type": "json_object"})
        return said.choices[0].message.content or ""

    return ask


def _gemini(llm: dict, model: str) -> Provider:
    from google import genai

    # its client counts in milliseconds
    client = genai.Client(http_options={"timeout": 1000 * llm.get("timeout_seconds", 30)})
    settings = {"temperature": llm.get("temperature", 0), "max_output_tokens": llm.get("max_tokens", 1000)}
    return lambda prompt: client.models.generate_content(model=model, contents=prompt, config=settings).text or ""


KNOWN: dict[str, Callable[[dict, str], Provider]] = {"Claude": _claude, "OpenAI": _openai, "Gemini": _gemini}


def provider_of(config: DomainConfig) -> Provider | None:
    """The provider that a configuration names; None if it names none, ConfigError if it can't be used."""
    llm = config.section("llm")
    name = str(llm.get("provider", "None"))
    if name == "None":
        return None
    if name not in KNOWN:
        raise ConfigError(f"unknown provider {name}")
    model = (llm.get("model") or {}).get(name)
    if not model:
        raise ConfigError(f"llm.model names no model for {name}")
    try:
        return KNOWN[name](llm, model)
    except ImportError as e:
        raise ConfigError(f"provider {name} needs a library that is not installed: {e.name}") from e
