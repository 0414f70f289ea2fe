"""Ignore rules: a documented subset of .gitignore, compiled to predicates over relative paths.

A rule that ends in a slash is about directories: by name, by a glob over the name, or, with a slash inside, by path. Other
rules are about paths if they hold a slash, else about names of files and directories. `!`, a leading slash and `**` have no
special meaning. Files below an ignored directory are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules that an index is always built with.
ALWAYS = (".git/", ".gramforge/")


def read_rules(text: str) -> list[str]:
    """The lines of an ignore file without trailing blanks, blank ones and comments left out."""
    return [x for x in (line.rstrip(" \t\r") for line in text.split("\n")) if x and not x.startswith("#")]


def glob_to_regex(glob: str, path: bool = False) -> str:
    """An anchored-free regular expression for a shell glob; path: wildcards don't match a slash."""
    any_, out, i = ("[^/]" if path else "."), "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += any_ + "*"
        elif c == "?":
            out += any_
        elif c == "\\" and i < len(glob):
            out += re.escape(glob[i])
            i += 1
        elif c == "[" and (m := re.compile(r"([!^]?)(\]?(?:\[:\w+:\]|\\.|[^\]\\])*)\]").match(glob, i)):
            body = re.sub(r"\[:(\w+):\]", lambda k: "\\p{" + {"xdigit": "XDigit", "alnum": "Alnum"}.get(k[1], k[1].capitalize()) + "}", m[2].replace("]", "\\]") if "[:" not in m[2] else m[2])
            body = re.sub(r"(?<!\\)([\[&^])", r"\\\1", body) if "\\p{" not in body else body
            out += ("(?!/)" if path else "") + "[" + ("^" if m[1] else "") + body + "]"
            i = m.end()
        else:
            out += re.escape(c)
    return out


@dataclass
class Rules:
    dir_names: list[str] = field(default_factory=list)
    dir_globs: list[str] = field(default_factory=list)
    dir_paths: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    @staticmethod
    def of(patterns: list[str] | tuple[str, ...]) -> Rules:
        out = Rules()
        for p in patterns:
            if p.endswith("/"):
                name = p[:-1]
                (out.dir_paths if "/" in name else out.dir_globs if any(c in name for c in "*?[") else out.dir_names).append(name)
            elif p:
                (out.paths if "/" in p else out.names).append(p)
        return out

    def file_regex(self) -> str | None:
        """Matches relative paths of files that are ignored for their own name or path."""
        parts = [f"(?:^|.*/){glob_to_regex(g, path=True)}" for g in self.names] + [f"^{glob_to_regex(g, path=True)}" for g in self.paths]
        return "(?s)^(?:" + "|".join(parts) + ")$" if parts else None

    def dir_regex(self) -> str | None:
        """Matches relative paths of which some directory above is ignored; of directories if a slash is added."""
        parts = [f"(?:^|.*/){re.escape(n)}/" for n in self.dir_names] + [f"(?:^|.*/){glob_to_regex(g, path=True)}/" for g in (*self.dir_globs, *self.names)]
        parts += [f"{re.escape(p)}/" for p in self.dir_paths] + [f"{glob_to_regex(p, path=True)}/" for p in self.dir_paths]
        return "(?s)^(?:" + "|".join(parts) + ")" if parts else None


def kept(path: Column, rules: Rules, files_only: bool = False) -> Column:
    """Whether a relative path stays. files_only: directory rules aren't asked, as for paths that an index returns."""
    out = F.lit(True)
    if regex := rules.file_regex():
        out = out & ~path.rlike(regex)
    if not files_only and (regex := rules.dir_regex()):
        out = out & ~path.rlike(regex)
    return out
