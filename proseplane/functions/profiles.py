"""Languages: the rules and the prompt builder that documents of each are scored and rewritten with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book

#: (article, violations, scene, strength) to a prompt.
Builder = Callable[[Column, Column, str, object], Column]
#: Of languages without a profile: no word lists, for those are English, but structure and rhythm.
OTHER = "*"


@dataclass(frozen=True)
class Profile:
    language: str
    rules: book.RuleSet
    #: Makes the rewrite prompt; None: the usual one.
    builder: Builder | None = None


_PROFILES: dict[str, Profile] = {}


def register(profile: Profile) -> Profile:
    """Adds a profile, or replaces that of its language."""
    _PROFILES[profile.language] = profile
    return profile


def profile_of(language: str) -> Profile:
    return _PROFILES.get(language, _PROFILES[OTHER])


def languages() -> list[str]:
    """With a profile of their own."""
    return sorted(set(_PROFILES) - {OTHER})


def reset() -> None:
    """Only the profiles that the package comes with."""
    _PROFILES.clear()
    register(Profile("en", book.DEFAULT))
    register(Profile(OTHER, replace(book.DEFAULT, words=(), phrases=(), pretence=(), signals=(), para_opening_enumeration=None)))


def rule_sets() -> dict[str, book.RuleSet]:
    """By language, for rule_table.as_table."""
    return {k: p.rules for k, p in sorted(_PROFILES.items())}


def key_of(language: str | Column) -> Column:
    """The profile of a column of languages; unknown ones and null have OTHER."""
    language = F.col(language) if isinstance(language, str) else language
    return F.when(language.isin(languages()), language).otherwise(F.lit(OTHER))


def rewrite_prompt(article: Column, violations: Column, language: str | Column, scene: str = "analysis", strength=None) -> Column:
    """The prompt of each row by its language's builder."""
    from proseplane.operators import prompts

    language = F.col(language) if isinstance(language, str) else language
    build = lambda p: (p.builder or prompts.rewrite_prompt)(article, violations, scene, strength)
    out = build(_PROFILES[OTHER])
    for name in languages():
        out = F.when(language == name, build(_PROFILES[name])).otherwise(out)
    return out


reset()
