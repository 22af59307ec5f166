"""Whether a documentation comment describes anything."""

from __future__ import annotations

import json
import re

# Comment marks and tags of the languages that are read here, tool directives, and words of no content.
_BLOCK = re.compile(r"\A\s*(?:/\*[*!]*|<!--|\(\*|\{-\|?|[rRuUbBfF]{0,2}\"\"\"|[rRuUbBfF]{0,2}'''|--\[\[|=begin\b)|(?:\*+/|-->|\*\)|-\}|\"\"\"|'''|\]\]|=end\b)\s*\Z")
_LINE = re.compile(r"^\s*(?://[/!]*|/\*+|\*+(?!\*)|#+!?(?![a-zA-Z]+\b:)|--+(?=\s)|;+(?=\s)|%+(?=\s)|'(?=\s)|\"\"\"|''')\s?")
_TAG = re.compile(r"^\s*(?:[@\\](\w+)|:(\w+)(?:\s+[^:\n]*)?:)\s*(.*)$", re.S)
_XML = re.compile(r"</?[A-Za-z][\w:.-]*(?:\s[^<>]*)?/?>")
_INLINE = re.compile(r"\{@\w+\s*([^}]*)\}")
_DECORATION = re.compile(r"^[\W_]*$|^\W*[-=*#~_+/<>]{3,}.*|.*[-=*#~_+]{3,}\W*$")
_REGION = re.compile(r"^#?\s*(?:pragma\s+)?(?:end\s*)?region\b.{0,60}$|^MARK\s*:.*$", re.I)
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|hack|tbd|tbc|wip|n/?a|none|nil|null|undocumented|placeholder|to do)\b.*|to be (?:done|documented|defined|determined|written|completed|added)\b.*"
    r"|(?:no|missing|add|insert|needs?|write|lacks?|without) (?:a |any |some |the )?(?:doc(?:umentation|s|string|umented)?|description|comments?)\b.{0,30}"
    r"|(?:description|documentation|summary|docs?|comment)s?(?: (?:of|for|about) (?:the |this |a )?(?:method|function|class|constructor|member|parameter)| (?:here|goes here|missing|pending|to follow|follows|needed))?"
    r"|(?:your|enter|put|insert|type|describe|document|explain)\b.{0,24}(?:here|this|me|it|description|documentation|comment)"
    r"|(?:this (?:is|was) )?auto(?:matically)?[- ]?generated\b.{0,60}|generated (?:method|constructor|function|code|stub)\b.{0,40}|(?:method|function|constructor) stub"
    r"|see (?:above|below|base|parent|super|interface|template)\b.{0,30}|lorem ipsum\b.*|foo(?: ?bar)?|blah.*|same as above|ditto|as above|self[- ]explanatory|待补充.*|待完善.*|未完成|暂无.*|无)\W*$", re.I | re.S)
_DIRECTIVE = re.compile(
    r"^\W*(?:noqa\b|nosec\b|nosonar\b|nolint\w*\b|eslint[- ]?\w*|tslint\s*:|jshint\b|jslint\b|jscs\s*:|stylelint-|biome-ignore|deno-lint-|ts-(?:ignore|nocheck|check|expect-error)\b|flow(?:fixme|-ignore)?$"
    r"|type\s*:\s*ignore|mypy\s*:|pyright\s*:|pylint\s*:|flake8\s*[:=]|ruff\s*:|pycodestyle|pydocstyle|isort\s*:|yapf\s*:|fmt\s*:\s*(?:on|off|skip)|black\s*:|autopep8|pragma\s*[: ]|pytype\s*:|sourcery\b"
    r"|go:[a-z]+|\+build\b|lint:(?:ignore|file-ignore)|golangci|checkstyle\s*[:.]|spotless\s*:|suppress(?:warnings|fbwarnings)?\b|suppresswarnings|pmd\b|formatter:o|noinspection\b|rustfmt\b|clippy\b|allow\s*\(|cfg\s*\(|inline\b$"
    r"|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|coverage\s*:|codecov\b|prettier-ignore|clang-(?:format|tidy)|nolintnextline|cppcheck|coverity|lint\s*-|resharper\b|disable\s+\w+\d+$|warning\s+disable|spell-?checker\s*:|cspell\s*:|codespell"
    r"|rubocop\s*:|phpcs\s*:|phpstan|psalm-|swiftlint\s*:|ktlint|detekt|shellcheck\b|hadolint|webpack\w*\s*:|@?jsx\w*\s|vim?\s*:\s*set|-\*-.*-\*-|language=\w+|sourcemappingurl|end ?region|@?preserve$|@?internal$|@?nocollapse$|@?hidden$|@?generated$)", re.I)
_ORIGIN = re.compile(
    r"^\W*(?:spdx-license-identifier\b.*|copyright\b.*|\(c\)\s.*|©.*|licen[sc]ed?\b.*|all rights reserved\b.*|permission is hereby\b.*|distributed under\b.*|this (?:file|code|source) (?:is|was) (?:licensed|part of|derived|adapted|copied|taken)\b.*|part of the\b.*\b(?:project|library|package)\W*"
    r"|(?:authors?|written|created|modified|updated|changed|added|maintained|maintainers?|reviewed|owner|contact|edited|last (?:modified|updated|changed|edited)|date|since|version|revision|history|ported|adapted|derived|copied|taken|imported|borrowed|based|originally|credits?|source|origin|translated|erstellt|autor|auteur)\b\s*"
    r"(?::.*|=.*|by\b.*|on\b\s*\W*\d.*|from\b.{0,80}|at\b\s*\W*\d.*|\W*v?\d[\d./:T -]*.{0,20}|in\b\s*\d.*)|\W*\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\W*.{0,20}|\$(?:id|revision|date|author)\b.*|<?\S+@\S+\.\w+>?)$", re.I | re.S)
_NO_TAGS = {"author", "authors", "since", "version", "date", "copyright", "license", "licence", "override", "inheritdoc", "inherit", "see", "link", "internal", "private", "public",
            "protected", "static", "async", "final", "readonly", "virtual", "abstract", "api", "ignore", "hidden", "package", "module", "namespace", "file", "category", "group", "name", "function", "method",
            "constructor", "class", "memberof", "test", "suppresswarnings", "nullable", "notnull", "nonnull", "jvmstatic", "experimental", "beta", "alpha", "generated", "created", "modified", "sourceof", "property", "staticmethod", "classmethod", "rtype", "type", "template", "typeparam"}
_PARAM_TAGS = {"param", "parameter", "arg", "argument", "tparam", "prop", "raises", "throws", "exception", "throw", "keyword", "attr", "cvar", "ivar", "var", "vartype", "raise", "retval"}
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:return|import|from|package|using|let|const|var|if|for|while|else|elif|try|except|raise|throw|print|pass|break|continue|assert|del|yield|await|new|use|fn|func|def|class|pub|public|private|static|void|int|#include|@\w+\()\b.*[(){};=:\[\]].*$"
    r"|^\s*[\w.$\[\]'\"]+\s*(?:[-+*/|&:]?=|:=|=>|->)\s*\S.*$|^\s*[\w.$:]+\([^)]*\)\s*$|^\s*[\w.$]+\((?:[^()]|\([^()]*\))*\)[;,]?\s*$|^\s*(?:>>>|\$)\s|^\s*(?:pass|break|continue|return)\s*;?$|^\s*[{}()\[\];,]+\s*$")
_STOP = set("a an the this that these those it its of to for in on at by with from and or as is are was be been will shall can may does do did not into onto over given which their his her".split()) | set(
    "method function constructor procedure routine helper class object member operation implementation def func fn ctor el la los las un una de del le les des du une der die das den dem ein eine einen".split())
_BUILDS = set("constructor ctor construct constructs default create creates creating created new instance instances initialize initializes initialise initialises initializer initialiser initialized initializing init inits make makes build builds object class empty instantiate instantiates "
              "no args arg argument arguments parameterless copy private public standard simple main primary basic konstruktor standardkonstruktor constructeur constructor erzeugt erstellt neue neues instanz crée crea nueva instancia nouvelle "
              "構造 コンストラクタ コンストラクター 构造函数 构造器 默认构造函数 创建实例 创建新实例 インスタンスを生成".split())
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_HUMP = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
_KEYS = re.compile(r"doc|comment|descri|summary|remarks", re.I)
_ABOUT = {"style", "format", "kind", "type", "language", "lang", "syntax", "encoding", "source", "line", "start", "end"}


def text_of(value) -> str:
    """The documentation text of a JSON value: a text, a list of texts, or an object that holds one."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(text_of, value) if t)
    if isinstance(value, dict):
        return "\n".join(t for t in (text_of(v) for k, v in value.items() if k.lower() not in _ABOUT) if t)
    return ""


def metadata_text(metadata: str | None) -> str | None:
    """The documentation text under whatever key of a JSON object; None where there is none or the JSON is broken."""
    if not metadata or not _KEYS.search(metadata):
        return None
    try:
        d = json.loads(metadata)
    except ValueError:
        return None
    found = "\n".join(t for t in (text_of(v) for k, v in d.items() if _KEYS.search(k)) if t.strip()) if isinstance(d, dict) else ""
    return found or None


def _stem(w: str) -> str:
    w = w.lower()
    for ends in (("'s", "’s", "ies", "es", "s"), ("ing", "ed", "e", "y", "i")):
        for end in ends:
            if w.endswith(end) and len(w) >= len(end) + 3:
                w = w[: -len(end)] + ("y" if end == "ies" else "")
                break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def name_words(name: str) -> set[str]:
    return {_stem(w) for w in _HUMP.findall(name or "")}


def lines_of(doc: str) -> list[str]:
    """The lines of a comment without comment marks and inline markup."""
    text = _BLOCK.sub("", _BLOCK.sub("", doc.replace("\r\n", "\n").replace("\r", "\n")))
    out = []
    for line in text.split("\n"):
        bare = _LINE.sub("", line)
        if re.match(r"\s*//", bare):
            bare = _LINE.sub("", bare)
        bare = _XML.sub(" ", _INLINE.sub(lambda m: m.group(1), bare))
        bare = re.sub(r"[`*_]{1,3}(\S.*?\S|\S)[`*_]{1,3}", r"\1", bare) if not _DECORATION.match(bare) else bare
        out.append(bare.rstrip())
    return out


def description(name: str | None, kind: str | None, doc: str | None) -> str | None:
    """The describing lines of a documentation, None where it is no description.

    What is left out, line by line: decoration and headings, placeholders, tags without explanation, directives to tools,
    code, and notes on authorship, date, licence and origin. What remains must say more than the symbol's own name, or
    of a constructor that it constructs. Any language counts.
    """
    if not doc or not doc.strip():
        return None
    kept = []
    own = name_words(name or "")
    builds = kind == "constructor" or (name or "") in ("new", "__init__", "constructor", "init", "initialize", "__construct")
    example = False
    for line in lines_of(doc):
        s = line.strip()
        if not s:
            continue
        if re.match(r"(?i)^(?:examples?|usage|beispiel|ejemplo|exemple)\s*:*$", s):
            example = True
            continue
        if example and (line[:1] in " \t" or _CODE.search(s)):
            continue
        if _DECORATION.match(s) or _REGION.match(s) or _DIRECTIVE.match(s) or _ORIGIN.match(s) or _PLACEHOLDER.match(s):
            continue
        tag = _TAG.match(s)
        if tag:
            word, rest = (tag.group(1) or tag.group(2)).lower(), tag.group(3)
            if _DIRECTIVE.match(word + " " + rest) or word in _NO_TAGS:
                continue
            named = s.startswith(":")
            words = [w.lower() for w in _WORDS.findall(re.sub(r"^\s*\{[^}]*\}", "", rest))]
            if word in _PARAM_TAGS and not named:
                words = words[len(_WORDS.findall((re.sub(r"^\s*\{[^}]*\}", "", rest).split() or [""])[0])):]
            if [w for w in words if w not in _STOP]:
                kept.append(rest.strip())
            continue
        if _CODE.search(s) and not re.search(r"[.!?。]$", s):
            continue
        kept.append(s)
    text = " ".join(kept)
    if not any(c.isalpha() for c in text):
        return None
    # a word of the text may be the name itself, or part of it
    said = [w for w in _WORDS.findall(text) if w.lower() not in _STOP and not {_stem(x) for x in _HUMP.findall(w)} <= own]
    said = [w.lower() for w in said]
    if not said:
        return None
    if builds and all(w in _BUILDS for w in said):
        return None
    if _PLACEHOLDER.match(text):
        return None
    return "\n".join(kept)
