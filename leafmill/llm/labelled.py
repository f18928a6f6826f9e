"""Labelled pages: what page furniture and page matter look like in six languages.

Furniture comes from the parts of ``furniture_texts``, error pages and other
short matter from those of ``residue_texts``; ``pages`` lays them out as pages
whose every line carries a label.  Names, numbers and layouts are drawn from a
seeded generator, so the labelled pages are the same everywhere and their
number is a documented bound (``PAGES``).
"""

from __future__ import annotations

import random

from . import furniture_texts, matter_texts, residue_texts

#: Labelled pages made for fitting (bounded, independent of the corpus).
PAGES = 700

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_SYL = "bel car dor fen gos har jor kel lum mor nel pra quo ral sil tam ule vim wex yor zan tro".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYL, k=self.r.randint(2, 4)))

    def date(self) -> str:
        r = self.r
        return r.choice([f"{r.randint(2015, 2026)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)} {r.choice(MONTHS)} {r.randint(2015, 2026)}"])

    def fill(self, phrase: str, site: str, lang: str) -> str:
        r, out = self.r, []
        for i, ch in enumerate(phrase):
            alone = (i == 0 or not phrase[i - 1].isascii() or not phrase[i - 1].isalnum()) and (i + 1 == len(phrase) or not phrase[i + 1].isascii() or not phrase[i + 1].isalnum())
            if ch in "STNDW" and alone:
                out.append({"S": site, "T": None, "N": str(r.randint(1, 99)), "D": None, "W": None}[ch] or {"T": self.title, "D": lambda *_: self.date(), "W": lambda *_: self.word()}[ch](site, lang))
            else:
                out.append(ch)
        return "".join(out)

    def title(self, site: str, lang: str) -> str:
        return matter_texts.title(self.r, lang, lambda: self.word().capitalize(), site)

    def sentence(self, site: str, lang: str) -> str:
        return matter_texts.sentence(self.r, lang, lambda: self.word().capitalize(), site)

    def page(self, languages: list[str] | None = None, without: tuple[str, ...] = ()) -> list[tuple[str, int]]:
        """Lines with their labels: 1 main body, 0 furniture, -1 blank; groups of furniture may be left out."""
        r = self.r
        lang = r.choice(languages) if languages else r.choices(furniture_texts.LANGUAGES, [8, 3, 3, 2, 2, 2])[0]
        site = self.word().capitalize() + r.choice(["", "", " Labs", " Cloud", "Kit"])
        pick = lambda group, k=1: [] if group in without else list(dict.fromkeys(self.fill(furniture_texts.phrase(r, group, lang), site, lang) for _ in range(k)))
        top: list[list[str]] = []
        if r.random() < 0.6:
            top.append(pick("controls", r.randint(1, 4)))
        if r.random() < 0.7:
            items = pick("menu", r.randint(3, 9))
            if r.random() < 0.3:
                items.insert(0, site)
            form = r.randrange(6)
            if form == 0:
                top.append(items)
            elif form in (1, 2):
                m = r.choice("*-•")
                top.append([f"{m} [{x}](/{x.lower().replace(' ', '-')})" if form == 2 else f"{m} {x}" for x in items])
            elif form == 3:
                top.append([" ".join(f"[{x}](/{x.lower().replace(' ', '-')})" for x in items)])
            else:
                top.append([" | ".join(items)])
        if r.random() < 0.5:
            top.append(pick("consent") + pick("buttons", r.randint(1, 2)))
        title = self.title(site, lang)
        if r.random() < 0.6:
            sep = r.choice([" > ", " / ", " » ", " › "])
            top.append([sep.join(pick("menu", r.randint(1, 2)) + [title])])

        def side() -> list[str]:
            m = r.choice(["", "* ", "- ", "• "])
            return pick("side") + [m + self.title(site, lang) for _ in range(r.randint(2, 6))]

        if r.random() < 0.4:
            top.append(side())
        if r.random() < 0.5:
            top.append(pick("byline"))
        if r.random() < 0.2:
            r.shuffle(top)
        body: list[tuple[list[str], int]] = []
        style = r.choices(range(6), [8, 2, 2, 2, 1, 3])[0]

        def heading(t: str, level: int) -> list[str]:
            if style == 0:
                return ["#" * level + " " + t + (" " + "#" * level if r.random() < 0.15 else "")]
            if style == 1:
                return [f"<h{level}>{t}</h{level}>"]
            if style == 2:
                return [t, ("=" if level == 1 else "-") * max(5, len(t))]
            if style == 3:
                return [f"{r.randint(1, 6)}.{r.randint(1, 9)} {t}"]
            if style == 4:
                return [f"**{t}**"]
            return ["# " + t] if level == 1 else ["## " + t]

        def para(k: int) -> list[str]:
            return [("" if lang == "ja" else " ").join(self.sentence(site, lang) for _ in range(k))]

        kind = r.random()
        if r.random() < 0.85:
            body.append((heading(title, 1), 1))
        if kind < 0.2:
            for _ in range(r.randint(1, 3)):
                body.append(([residue_texts.placeholder(r) if r.random() < 0.15 else residue_texts.text(r)], 1))
        else:
            for _ in range(r.randint(1, 7)):
                body.append((para(r.randint(1, 5)), 1))
                what, w = r.random(), self.word()
                if what < 0.14:
                    m = r.choice(["- ", "* ", "1. ", "• "])
                    body.append(([f"{m}`{w}_{i}`: " + para(1)[0] if r.random() < 0.6 else m + para(1)[0] for i in range(r.randint(2, 5))], 1))
                elif what < 0.26:
                    f = r.choice(["```", "~~~", "```python", "```json", "```sh"])
                    code = r.choice([[f"def {w}_run(tables, limit=9):", f"    # keep {w} rows", f"    return {w}.trim(limit)"], ["{", f'  "{w}_key": 12,', f'  "rows": ["a", "{w}"]', "}"], [f"[{w}]", f"# batches for the {w} record", f"{w}_size = 4"], [f"{w}-cli --worker 9 ./folder", f"## second run for {w}", f"{w}-cli trim --dry-run"], [f"<h1>{{{{ {w}.title }}}}</h1>", f"{{% for x in {w} %}}"]])
                    if r.random() < 0.3:
                        body.append((["    " + x for x in code], 1))
                    else:
                        body.append(([f, *code, f[:3]], 1))
                elif what < 0.36:
                    body.append((["| Name | Type | Default |", "| --- | --- | --- |", *(f"| {w}_{i} | int | {r.randint(1, 99)} |" for i in range(r.randint(1, 4)))], 1))
                elif what < 0.42:
                    body.append((["> " + para(1)[0]], 1))
                elif what < 0.46:
                    body.append((["---"], 1))
                elif what < 0.62:
                    body.append((heading(self.title(site, lang), r.choice([2, 2, 3])), 1))
                if r.random() < 0.16:
                    body.append((r.choice([lambda: pick("prompts"), side, lambda: pick("byline"), lambda: pick("consent")])(), 0))
                if r.random() < 0.08:
                    body.append((["\n".join([])] + [x for x in para(1)[0].split(", ")], 1))
        end: list[list[str]] = []
        if r.random() < 0.5:
            end.append(pick("prompts", r.randint(1, 3)))
        if r.random() < 0.25:
            end.append(side())
        if r.random() < 0.4:
            end.append(pick("steps", r.randint(1, 2)))
        if r.random() < 0.65:
            end.append(pick("footer", r.randint(1, 6)))
        groups = [(g, 0) for g in top] + body + [(g, 0) for g in end]
        out: list[tuple[str, int]] = []
        for g, label in groups:
            for x in g:
                if not x.strip():
                    continue
                if not label:
                    u = r.random()
                    x = x.upper() if u < 0.05 else x.lower() if u < 0.09 else x
                    x = x.replace(" ", "  ", 2) if r.random() < 0.04 else x
                    x = x.replace(" ", " ", 2) if r.random() < 0.03 else x
                    x = f"  {x} " if r.random() < 0.04 else x
                out.append((x, label))
            if not (r.random() < 0.15 and (not label or g[0].startswith("#"))):
                out.append(("", -1))
        return out


def pages(count: int = PAGES, seed: int = 5, languages: list[str] | None = None, without: tuple[str, ...] = ()) -> list[list[tuple[str, int]]]:
    m = _Maker(seed)
    return [m.page(languages, without) for _ in range(count)]
