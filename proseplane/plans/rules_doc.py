"""The rules as one Markdown page, the same for the same rules."""

from __future__ import annotations

from pathlib import Path

from proseplane.functions import rulebook as book


def markdown(rules: book.RuleSet = book.DEFAULT) -> str:
    out = [f"# Style rules {rules.version}", ""]
    for title, group in (("Words", rules.words), ("Phrases", rules.phrases)):
        out += [f"## {title}", ""]
        for r in group:
            out += [f"### {r.name}", "", f"Weight {r.weight}, soft threshold {r.soft}, hard threshold {r.hard}.", "", ", ".join(f"`{p}`" for p in r.patterns), ""]
    out += ["## Pretence", ""]
    for r in rules.pretence:
        out += [f"### {r.name}", "", f"Weight {r.weight}.", "", *(f"- `{p}`" for p in r.patterns), ""]
    out += ["## Missing signals", ""]
    for r in rules.signals:
        out += [f"### {r.name}", "", f"Weight {r.weight} for each signal short of {r.least}, from {r.min_length} characters.", "", f"`{r.pattern}`", ""]
    out += ["## Shape and rhythm", ""]
    for name in ("heading_density", "list_density", "sentence_length_cv", "short_sentence_ratio", "paragraph_uniformity", "para_opening_enumeration"):
        if value := getattr(rules, name):
            out.append(f"- {name}: {', '.join(str(v) for v in value)}")
    return "\n".join(out) + "\n"


def write(path: str, check: bool = False) -> int:
    """Writes the page; with check only compares: 1 if it differs."""
    page = markdown()
    if check:
        return int(not Path(path).exists() or Path(path).read_text(encoding="utf-8") != page)
    Path(path).write_text(page, encoding="utf-8")
    return 0
