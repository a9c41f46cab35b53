"""Adapter for the WordPress code reference: listing, class and method pages, and methods that only delegate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Source
from .html import Node, parse

BASE = "https://developer.wordpress.org"
CLASSES = "/reference/classes/"

# Classes to fetch first.
FIRST_CLASSES = frozenset("""
wp_query wp_post wp_user wp_error wp_term wp_comment wp_widget wp_theme wp_hook wp_rewrite wp_roles wp_role
wp_rest_request wp_rest_response wp_rest_server wp_rest_controller wp_taxonomy wp_post_type wp_scripts wp_styles
wp_customize_manager wp_customize_control wp_nav_menu_item wp_http wp_filesystem_base wp_filesystem_direct
wp_session_tokens wp_meta_query wp_tax_query wp_date_query wp_block wp_block_type wpdb
""".split())

# Texts of navigation.
NAVIGATION = ("view all references", "view on trac", "view on github", "you must log in", "contribute a note", "user contributed notes")

# Functions whose lone call doesn't make a method a wrapper.
VOID_BUILTINS = frozenset("unset echo print die exit trigger_error error_log header setcookie session_start session_destroy".split())

# Functions whose returned call doesn't make a method a wrapper.
BUILTINS = frozenset("""
array isset empty is_null is_array is_string is_object is_int is_float is_bool is_numeric is_callable is_resource is_integer is_long
is_double is_real is_finite is_infinite is_nan is_a count strlen intval floatval strval boolval compact extract list true false null return
str_replace sprintf substr implode explode trim ltrim rtrim
in_array array_merge array_keys array_values array_map array_filter array_pop array_push array_key_exists array_key_first array_key_last
array_splice array_slice array_unique array_column array_combine array_diff array_intersect array_reverse array_search array_sum
key current next prev reset end sizeof
strcmp strcasecmp strpos strrpos strstr strtolower strtoupper ucfirst lcfirst ucwords str_pad str_repeat str_word_count wordwrap nl2br
chunk_split number_format
html_entity_decode htmlspecialchars htmlentities htmlspecialchars_decode strip_tags urlencode urldecode rawurlencode rawurldecode
http_build_query
property_exists class_exists method_exists function_exists defined gettype settype get_object_vars get_class get_parent_class
file_exists file_get_contents file_put_contents is_readable is_writable is_dir is_file is_link mkdir rmdir unlink rename copy chmod
realpath dirname basename pathinfo glob tempnam sys_get_temp_dir
date time strtotime mktime microtime gmdate date_create
md5 sha1 hash crc32 base64_encode base64_decode
var_export print_r var_dump debug_backtrace debug_print_backtrace trigger_error error_log
header setcookie session_start session_destroy headers_sent header_remove
abs ceil floor round max min pow sqrt log rand mt_rand
ob_start ob_end_clean preg_match preg_replace preg_quote json_encode json_decode
sleep usleep call_user_func call_user_func_array func_get_args func_num_args
wp_parse_args absint esc_html esc_attr esc_url sanitize_text_field _deprecated_function _doing_it_wrong apply_filters do_action
has_filter add_filter add_action remove_filter remove_action current_user_can wp_die wp_redirect wp_safe_redirect
checked selected disabled
""".split())

# Patterns of delegation.
CALL_PATTERNS = (
    (re.compile(r"^\s*return\s+\$this->(\w+)\s*\(", re.ASCII), "self_method"),
    (re.compile(r"^\s*return\s+(?:self|static)::(\w+)\s*\(", re.ASCII), "self_method"),
    (re.compile(r"^\s*return\s+(\w+)::(\w+)\s*\(", re.ASCII), "static_method"),
    (re.compile(r"^\s*return\s+(\w+)\s*\(", re.ASCII), "function"),
)
LONE_PATTERNS = (
    (re.compile(r"^\s*\$this->(\w+)\s*\(", re.ASCII), "self_method"),
    (re.compile(r"^\s*(\w+)\s*\(", re.ASCII), "function"),
)
MOST_BODY_LINES = 5


# Column forms of what depends on a url or a heading alone.


def slug_of_url(url: Column) -> Column:
    """A url's last part."""
    return F.element_at(F.split(F.regexp_replace(url, "/$", ""), "/"), -1)


def class_slug(url: Column) -> Column:
    """A class page's slug, unique within the site: the path below the classes, joined by dashes."""
    prefix = BASE + CLASSES
    path = F.regexp_replace(F.when(F.startswith(url, F.lit(prefix)), F.substring(url, len(prefix) + 1, 1 << 20)).otherwise(url), "/$", "")
    return F.lower(F.replace(path, F.lit("/"), F.lit("-")))


def class_priority(slug: Column) -> Column:
    """0 for the most used classes, 1 for others of the core, 2 for the rest."""
    low = F.lower(slug)
    return F.when(low.isin(*sorted(FIRST_CLASSES)), 0).when(F.startswith(low, F.lit("wp_")), 1).otherwise(2)


def clean_class_name(heading: Column) -> Column:
    """'class X {}' as X."""
    name = F.regexp_replace(F.regexp_replace(heading, "^class ", ""), "^Class ", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, r" \{\}$", ""), r"\{\}$", ""))


def method_name(signature: Column) -> Column:
    """The method's name: after the first '::' up to '(' or blank; else the last word before '('; else all."""
    after = F.regexp_extract(signature, r"(?s)^.*?::([^( ]*)", 1)
    before = F.regexp_extract(signature, r"(?s)^[^(]*?(\S+)\s*\(", 1)
    return F.when(F.contains(signature, F.lit("::")), after).when(before != "", before).otherwise(signature)


def is_navigation(text: str) -> bool:
    return any(n in text.lower() for n in NAVIGATION)


def _absolute(href: str) -> str:
    return href if href.startswith("http") else BASE + href


def _sections(doc: Node, heading: str) -> list[Node]:
    """The elements that hold an h2 of that id."""
    return [h.parent for h in doc.find(f"h2#{heading}")]


def _text(n: Node | None) -> str:
    return n.stripped() if n is not None else ""


def _cells(row: Node) -> list[Node]:
    return row.find("td")


def code_after(doc: Node, heading: str) -> str:
    """The longest code block (in bytes; the first of equals) in the heading's section."""
    blocks = [c.stripped() for s in _sections(doc, heading) for c in s.find("pre code, code.language-php")]
    return max(blocks, key=lambda b: len(b.encode()), default="")


def any_code(doc: Node) -> str:
    """A page's source: after its heading, else in the source block, else in the first section's code."""
    for found in (code_after(doc, "source"), _text(doc.first(".wp-block-wporg-code-reference-source pre code")), _text(doc.first("section pre code"))):
        if found:
            return found
    return ""


def _heading(doc: Node, url: str) -> str:
    h1 = _text(doc.first("article h1, main h1"))
    if not h1:
        raise ValueError(f"no h1 on {url}")
    return h1


def _meta_description(doc: Node) -> str:
    m = doc.first("meta[name=description]")
    return m.attrs.get("content", "").strip() if m is not None else ""


def _class_description(doc: Node) -> str:
    """The meta description, else up to three paragraphs of the first content block, headings between them or not."""
    if meta := _meta_description(doc):
        return meta
    block = doc.first("article .wp-block-post-content, main section")
    told = [p.stripped() for p in (block.elements() if block is not None else []) if p.tag == "p"]
    return " ".join([t for t in told if t and not is_navigation(t)][:3])


def _listed_properties(section: Node) -> list[dict]:
    out = []
    for row in section.find("dt, tr"):
        cells = _cells(row)
        name = _text(row.first("code")) or _text(cells[0] if cells else None)
        after = row.next()
        told = after if after is not None and after.tag == "dd" else (cells[-1] if cells else None)
        if name:
            out.append({"name": name, "description": _text(told)})
    return out


def _table_properties(doc: Node) -> list[dict]:
    out = []
    for table in doc.find(".wp-block-wporg-code-reference-table table"):
        said = _text(table.parent.previous()).lower()
        if "propert" not in said and "member" not in said:
            continue
        for row in table.find("tr"):
            cells = _cells(row)
            if len(cells) >= 2 and (name := "".join(c.text() for c in cells[0].find("code")).strip() or cells[0].stripped()):
                out.append({"name": name, "description": cells[1].stripped()})
    return out


_DECLARED = re.compile(r"^\s*(?:public|protected|private|var) (?:static )?(\$[^ =;]+)", re.MULTILINE)


def _properties(doc: Node, source: str) -> list[dict]:
    """By the headings' ids, else by their texts, else in reference tables, else as declared in the source."""
    by_id = [p for h in doc.find("h2#properties, h2#members") for p in _listed_properties(h.parent)]
    if by_id:
        return by_id
    named = [h for h in doc.find("h2") if any(w in h.text().lower() for w in ("properties", "members"))]
    return [p for h in named for p in _listed_properties(h.parent)] or _table_properties(doc) or [{"name": n, "description": ""} for n in _DECLARED.findall(source)]


def _without(text: str, word: str) -> str:
    at = text.lower().find(word)
    return text[:at] + text[at + len(word) :]


def _listed_parameter(dt: Node) -> dict:
    name = _text(dt.first("code"))
    rest = dt.stripped().removeprefix(name).strip()
    required = "required" in rest.lower()
    for word in ("required", "optional"):
        if word in rest.lower():
            rest = _without(rest, word)
            break
    return {"name": name, "type": rest.strip(), "required": required, "description": _text(dt.next())}


def _table_parameter(row: Node) -> dict:
    cells = _cells(row)
    if len(cells) < 2:
        return {"name": ""}
    name = "".join(c.text() for c in cells[0].find("code")).strip()
    said = cells[0].stripped()
    return {"name": name, "type": said.removeprefix(name).strip(), "required": "required" in said.lower(), "description": cells[1].stripped()}


def _parameters(doc: Node) -> list[dict]:
    out: list[dict] = []
    for section in _sections(doc, "parameters"):
        out += [p for p in map(_listed_parameter, section.find("dt")) if p["name"]]
        if not out:
            out += [p for p in map(_table_parameter, section.find("table tr")) if p["name"]]
    return out


def _returns(doc: Node) -> tuple[str, str]:
    kind = told = ""
    for heading in doc.find("h2#return"):
        after = heading.siblings_after()
        codes = [c for s in after for c in s.find("code, span.return-type")]
        kind = codes[0].stripped() if codes else kind
        for s in after:
            if s.tag in ("p", "dl", "dd") and not told:
                told = s.stripped().removeprefix(kind).strip()
        if not kind:
            first, _, rest = heading.parent.stripped().removeprefix(heading.stripped()).strip().partition("\n")
            kind, told = first.strip(), rest.strip() if rest else told
    return kind, told


def _since(doc: Node) -> str:
    """The last changelog row that tells of an introduction."""
    rows = [_cells(r) for s in _sections(doc, "changelog") for r in s.find("table tr")]
    found = [c[0].stripped() for c in rows if len(c) >= 2 and "introduced" in c[1].text().lower() and c[0].stripped()]
    return found[-1] if found else ""


def _relations(doc: Node) -> list[dict]:
    out = []
    for table in (t for s in _sections(doc, "related") for t in s.find("table")):
        kind = "used_by" if "used by" in _text(table.first("th")).lower() else "uses"
        for cells in map(_cells, table.find("tbody tr")):
            link = cells[0].first("a") if len(cells) >= 2 else None
            if link is not None and link.stripped():
                href = link.attrs.get("href", "")
                out.append({"kind": kind, "target_name": link.stripped(), "target_url": _absolute(href) if href else "", "description": cells[1].stripped()})
    return out


def body_lines(source: str) -> list[str]:
    """A function's body without comments and blanks. A line with a block comment is dropped as a whole; the body ends where braces close."""
    out: list[str] = []
    depth, inside, comment = 0, False, False
    for line in map(str.strip, source.split("\n")):
        if comment or "/*" in line:
            comment = "*/" not in line
            continue
        if line.startswith(("//", "#")):
            continue
        depth += line.count("{") - line.count("}")
        if inside:
            if depth <= 0:
                break
            out += [line] if line else []
        elif "{" in line:
            inside = True
            rest = line.partition("{")[2].strip()
            out += [rest] if rest not in ("", "}") else []
    return out


class WordPress(Source):
    id = "/wordpress/classes"

    def meta(self) -> dict:
        return {"id": self.id, "name": "WordPress", "description": "WordPress class reference", "source_url": BASE, "version": "6.7", "trust_score": 0.9}

    def listing(self, html: str) -> tuple[list[str], int]:
        doc = parse(html)
        links = [a.attrs.get("href", "") for a in doc.find(".wp-block-wporg-code-short-title a")]
        urls = [_absolute(h) for h in links if CLASSES in h]
        if not urls:
            raise ValueError("no class urls on the page")
        numbers = [a.attrs.get("href", "").partition("/page/")[2].removesuffix("/") for a in doc.find("nav.wp-block-query-pagination a")]
        return urls, max([1, *(int(n) for n in numbers if n.isascii() and n.isdigit())])

    def entity(self, url: str, html: str) -> tuple[dict, list[str]]:
        doc = parse(html)
        name = _heading(doc, url)
        for start in ("class ", "Class "):
            name = name.removeprefix(start)
        name = name.removesuffix(" {}").removesuffix("{}").strip()
        slug = url.removeprefix(BASE + CLASSES).removesuffix("/").replace("/", "-").lower()
        file = _text(doc.first("a[href*='/reference/files/']"))
        if not file:
            codes = [s.first("code") for s in _sections(doc, "source")]
            file = next((c.stripped() for c in reversed(codes) if c is not None and c.text().endswith(".php")), "")
        source = any_code(doc)
        row = {"slug": slug, "name": name, "kind": "class", "description": _class_description(doc), "source_file": file, "source_code": source, "url": url, "properties": _properties(doc, source)}
        hrefs = [a.attrs.get("href", "") for s in _sections(doc, "methods") for a in s.find("table a, .wp-block-table a")]
        links = [_absolute(h) for h in hrefs if CLASSES in h]
        if not links:
            own = [_absolute(h) for h in (a.attrs.get("href", "") for a in doc.find("table a")) if f"{CLASSES}{slug}/" in h]
            links = [h for h in own if h != url and not h.endswith(f"{slug}/")]
        return row, list(dict.fromkeys(links))

    def method(self, url: str, html: str) -> dict:
        doc = parse(html)
        signature = _heading(doc, url)
        if "::" in signature:
            name = re.split(r"[( ]", signature.partition("::")[2], maxsplit=1)[0]
        else:
            before = signature.partition("(")[0].split() if "(" in signature else []
            name = before[-1] if before else signature
        told = _meta_description(doc)
        if not told or is_navigation(told):
            paragraphs = [p.stripped() for s in _sections(doc, "description") for p in s.find("p")]
            told = " ".join(t for t in paragraphs if t and not is_navigation(t))
        if not told:
            first = _text(doc.first("article .wp-block-post-content > p, main section > p"))
            told = "" if is_navigation(first) else first
        kind, about = _returns(doc)
        return {"slug": name.lower(), "name": name, "signature": signature, "description": told, "parameters": _parameters(doc), "return_type": kind, "return_desc": about, "source_code": any_code(doc), "url": url, "since": _since(doc), "relations": _relations(doc)}

    def source_code(self, html: str) -> str:
        code = code_after(parse(html), "source")
        if not code:
            raise ValueError("no source code on the page")
        return code

    def wrapper(self, source_code: str) -> tuple[bool, str, str]:
        lines = body_lines(source_code or "")
        if not 0 < len(lines) <= MOST_BODY_LINES:
            return False, "", ""
        found = (self._call(line, CALL_PATTERNS, BUILTINS) for line in lines)
        hit = next((f for f in found if f), None) or (self._call(lines[0], LONE_PATTERNS, VOID_BUILTINS) if len(lines) == 1 else None)
        return (True, *hit) if hit else (False, "", "")

    @staticmethod
    def _call(line: str, patterns, builtins: frozenset[str]) -> tuple[str, str] | None:
        for pattern, kind in patterns:
            if m := pattern.match(line):
                if m[1] == "parent" and kind == "static_method":
                    return None
                if kind != "function" or m[1] not in builtins:
                    return "::".join(m.groups()), kind
        return None

    def wrapper_url(self, target: str, kind: str, entity_slug: str) -> str:
        if kind == "function":
            return f"{BASE}/reference/functions/{target.lower()}/"
        if kind == "self_method":
            return f"{BASE}{CLASSES}{entity_slug}/{target.lower()}/"
        owner, colons, name = target.partition("::")
        return f"{BASE}{CLASSES}{owner.lower()}/{name.lower()}/" if kind == "static_method" and colons else ""
