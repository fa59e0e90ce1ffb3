"""Grammars and lexers of the languages whose files are checked for validity.

The grammars are written for recognition: precedence is left out, what only a later stage
of a compiler rejects (undefined labels, repeated declarations) is accepted.
"""

from __future__ import annotations

import re

from .gll import Grammar, Recogniser


class Invalid(Exception):
    """The text cannot even be cut into tokens or folded."""


# ---------------------------------------------------------------- JSON, TOML

JSON = Grammar(
    """
value = BRACE<members> | BRACK<elements> | STRING | NUMBER | "true" | "false" | "null"
members = (member ("," member)*)?
member = STRING ":" value
elements = (value ("," value)*)?
"""
)

TOML = Grammar(
    """
file = line*
line = NL | (BRACK<table> | key "=" value) NL
table = key | BRACK<key>
key = part ("." part)*
part = BARE | STRING
value = STRING | MULTI | SCALAR | BRACK<array> | BRACE<inline>
array = NL* (value NL* ("," NL* value NL*)* ("," NL*)?)?
inline = (key "=" value ("," key "=" value)*)?
""",
    {"BARE": ["BARE", "BARE_SCALAR"], "SCALAR": ["SCALAR", "BARE_SCALAR"]},
)

# ---------------------------------------------------------------- Python

PYTHON = Grammar(
    """
file = stmt*
stmts = stmt+
stmt = line | compound
line = small (";" small)* ";"? NL
small = exprstmt | "pass" | "break" | "continue" | "return" stars? | "raise" (expr ("from" expr)?)? | "global" NAME ("," NAME)* | "nonlocal" NAME ("," NAME)* | "del" stars | "assert" expr ("," expr)? | "import" dotted alias? ("," dotted alias?)* | "from" from "import" ("*" | PAREN<names> | NAME alias? ("," NAME alias?)*) | "type" NAME BRACK<tparams>? "=" expr
exprstmt = stars | yield | (places "=")+ (stars | yield) | single AUG (stars | yield) | single ":" expr ("=" (stars | yield))?
places = place ("," place)* ","?
place = "*"? (NAME | member | PAREN<inplaces> | BRACK<inplaces>)
inplaces = places?
single = NAME | member | PAREN<single>
member = atom (trailer* ("." NAME | BRACK<slices>))
from = DOTS* dotted | DOTS+
dotted = NAME ("." NAME)*
alias = "as" NAME
names = NAME alias? ("," NAME alias?)* ","?
yield = "yield" ("from" expr | stars)?
stars = bare ("," bare)* ","?
bare = "*" expr | expr
star = "*" expr | named
named = NAME ":=" expr | expr
expr = "lambda" lparams? ":" expr | oper ("if" oper "else" expr)?
lparams = lparam ("," lparam)* ","?
lparam = ("*" | "**")? NAME ("=" expr)? | "*" | "/"
oper = unary (BINOP unary)*
unary = PREFIX* "await"? atom trailer*
atom = NAME | NUMBER | STRING+ | "None" | "True" | "False" | "..." | PAREN<group> | BRACK<list> | BRACE<braces>
trailer = "." NAME | PAREN<args> | BRACK<slices>
group = (yield | named comp | star ("," star)* ","?)?
comp = ("async"? "for" targets "in" oper ("if" named1)*)+
named1 = NAME ":=" expr | oper | "lambda" lparams? ":" expr
targets = places
args = ((given ("," given)* ("," keyed)* | keyed ("," keyed)*) ","?)?
given = named comp? | "*" expr
keyed = NAME "=" expr | "*" expr | "**" expr
slices = slice ("," slice)* ","?
slice = expr? ":" expr? (":" expr?)? | named | "*" expr
list = (star comp | star ("," star)* ","?)?
braces = (pair ("," pair)* ","? | expr ":" expr comp | star comp | star ("," star)* ","?)?
pair = expr ":" expr | "**" expr
params = (param ("," param)* ","?)?
param = ("*" | "**")? NAME (":" ("*"? expr))? ("=" expr)? | "*" | "/"
tparams = tparam ("," tparam)* ","?
tparam = ("*" | "**")? NAME (":" expr)? ("=" expr)?
body = ":" (line | NL BLOCK<stmts>)
compound = "if" named body ("elif" named body)* ("else" body)? | "while" named body ("else" body)? | "for" targets "in" stars body ("else" body)? | try | "with" with body | definition | "async" ("for" targets "in" stars body ("else" body)? | "with" with body) | "match" stars ":" NL BLOCK<cases>
try = "try" body (("except" (expr alias?)? body)+ ("else" body)? ("finally" body)? | ("except" "*" expr alias? body)+ ("else" body)? ("finally" body)? | "finally" body)
with = item ("," item)* | PAREN<items>
items = item ("," item)* ","?
item = expr ("as" place)?
definition = ("@" named NL)* ("async"? "def" NAME BRACK<tparams>? PAREN<params> ("->" expr)? body | "class" NAME BRACK<tparams>? PAREN<args>? body)
cases = ("case" patterns ("if" named)? body)+
patterns = star alias? ("," star alias?)* ","?
""",
    {
        "NAME": ["NAME", "match", "case", "type"],
        "BINOP": ["+", "-", "*", "**", "/", "//", "%", "@", "<<", ">>", "&", "|", "^", "<", ">", "<=", ">=", "==", "!=", "and", "or", "in", "is", "NOTIN", "ISNOT"],
        "PREFIX": ["not", "-", "+", "~"],
        "AUG": ["AUG"],
        "DOTS": [".", "..."],
    },
)

# ---------------------------------------------------------------- ECMAScript and TypeScript

_SCRIPT = """
module = element*
element = import | export | stmt
import = "import" (STRING attrs? | clause "from" STRING attrs?) EOS
attrs = "with" BRACE<object>
clause = TYPEKW? (binding1 ("," (star_as | BRACE<specs>))? | star_as | BRACE<specs>)
binding1 = NAME
star_as = "*" "as" NAME
specs = (spec ("," spec)* ","?)?
spec = TYPEKW? (IDENT | STRING) ("as" (IDENT | STRING))?
export = "export" (TYPEKW? (BRACE<specs> ("from" STRING attrs?)? | "*" ("as" (IDENT | STRING))? "from" STRING attrs?) EOS | "default" (function | class | assign EOS | TSEXPORT) | declaration | EXPORTEQ)
declaration = var EOS | function | class | TSDECL
stmts = stmt*
stmt = BRACE<stmts> | var EOS | function | class | TSDECL | "if" PAREN<expr> stmt ("else" stmt)? | "for" "await"? PAREN<forhead> stmt | "while" PAREN<expr> stmt | "do" stmt "while" PAREN<expr> ";"? | "continue" NAME? EOS | "break" NAME? EOS | "return" expr? EOS | "throw" expr EOS | "try" BRACE<stmts> ("catch" PAREN<catchparam>? BRACE<stmts> ("finally" BRACE<stmts>)? | "finally" BRACE<stmts>) | "switch" PAREN<expr> BRACE<cases> | NAME ":" stmt | "debugger" EOS | ";" | expr EOS
catchparam = binding ANN
forhead = (var | expr)? ";" expr? ";" expr? | (("var" | "let" | "const") binding | chain) ("of" assign | "in" expr)
cases = (("case" expr | "default") ":" stmt*)*
var = ("var" | "let" | "const" | USING) declarator ("," declarator)*
declarator = binding "!"? ANN ("=" assign)?
binding = NAME | BRACK<arraypat> | BRACE<objectpat>
arraypat = ","* ("..."? binding ("=" assign)? (","+ "..."? binding ("=" assign)?)* ","*)?
objectpat = (propat ("," propat)* ","?)?
propat = "..." binding | (IDENT | STRING | NUMBER | BRACK<assign>) ":" binding ("=" assign)? | NAME ("=" assign)?
params = (param ("," param)* ","?)?
param = DECORATION "..."? MODIFIER* PARAMNAME "?"? ANN ("=" assign)?
function = "async"? "function" "*"? NAME? GENERIC PAREN<params> RET FBODY
fblock = BRACE<stmts>
class = DECORATION ABSTRACT "class" NAME? GENERIC ("extends" chain TYPEARGS)? IMPLEMENTS BRACE<members>
members = member*
member = ";" | "static" BRACE<stmts> | DECORATION MODS (method | field EOS | INDEX)
method = "async"? "*"? key "?"? GENERIC PAREN<params> RET FBODY | ("get" | "set") key PAREN<params> RET FBODY
field = key ("?" | "!")? ANN ("=" assign)?
key = IDENT | STRING | NUMBER | BRACK<assign> | PRIVATE
expr = assign ("," assign)*
assign = arrow | chain ASSIGN assign | cond | "yield" "*"? assign?
cond = binary ("?" assign ":" assign)?
binary = unary (BINOP unary | ASOP)*
unary = PREFIX* chain POSTFIX?
chain = "new"* primary trailer* | "new" "." IDENT trailer*
primary = NAME | NUMBER | STRING | REGEX | TPL<template> | "this" | "super" | "null" | "true" | "false" | PRIVATE | PAREN<expr> | BRACK<array> | BRACE<object> | function | class | "import" (PAREN<args> | "." IDENT)
template = BRACE<expr>*
trailer = "." (IDENT | PRIVATE) | "?." (IDENT | PRIVATE | PAREN<args> | BRACK<expr> | TPL<template>) | CALLARGS PAREN<args> | BRACK<expr> | TPL<template> | BANG
array = ","* (item (","+ item)* ","*)?
item = "..."? assign
args = (item ("," item)* ","?)?
object = (prop ("," prop)* ","?)?
prop = "..." assign | key ":" assign | NAME ("=" assign)? | method
arrow = "async"? (NAME | GENERIC PAREN<params> RET) "=>" (BRACE<stmts> | assign)
"""

_JS = """
TSEXPORT:= NEVER
EXPORTEQ:= NEVER
TSDECL:= NEVER
USING:= NEVER
ANN:= empty
MODIFIER*:= empty
PARAMNAME:= binding
"?"? ANN ("=" assign)?:= ("=" assign)?
"!"? ANN:= empty
DECORATION:= empty
GENERIC:= empty
RET:= empty
FBODY:= fblock
ABSTRACT:= empty
TYPEARGS:= empty
IMPLEMENTS:= empty
MODS:= jsmods
| INDEX:=
key "?"? PAREN:= key PAREN
key ("?" | "!")?:= key
ASOP:= NEVER
CALLARGS:= empty
| BANG:=
TYPEKW?:= empty
"""

_TS = """
TSEXPORT:= interface
EXPORTEQ:= "=" expr EOS | "as" "namespace" NAME EOS
TSDECL:= tsdecl
USING:= NEVER
ANN:= ann
MODIFIER:= modifier
PARAMNAME:= (binding | "this")
DECORATION:= decorators
GENERIC:= generic?
RET:= ret
FBODY:= (fblock | EOS)
ABSTRACT:= "abstract"?
TYPEARGS:= typeargs?
IMPLEMENTS:= ("implements" types)?
MODS:= modifier*
INDEX:= BRACK<indexsig> ann EOS
ASOP:= (("as" | "satisfies") type | ">" ">" ">"? unary | ">" ">"? ">=" unary)
CALLARGS:= typeargs?
BANG:= "!"
TYPEKW:= "type"
"""

_TSRULES = """
ann = (":" type)?
ret = (":" (("asserts"? (NAME | "this") "is" type) | "asserts" (NAME | "this") | type))?
decorators = ("@" chain)*
modifier = "public" | "private" | "protected" | "readonly" | "static" | "abstract" | "override" | "declare" | "accessor"
generic = "<" tparam ("," tparam)* ","? ">"
tparam = "const"? ("in" | "out")* NAME ("extends" type)? ("=" type)?
typeargs = "<" type ("," type)* ","? ">"
types = type ("," type)*
type = (NAME | "this") "is" type | utype ("extends" utype "?" type ":" type)? | "new"? generic? PAREN<fparams> "=>" type | "abstract" "new" generic? PAREN<fparams> "=>" type
utype = ("|" | "&")? otype (("|" | "&") otype)*
otype = ("keyof" | "unique" | "readonly" | "infer")* ptype (BRACK<index>)*
index = type?
ptype = tname typeargs? | PAREN<type> | BRACK<tuple> | BRACE<typemembers> | STRING | "-"? NUMBER | "null" | "true" | "false" | "void" | "this" | TPL<tpltype> | "typeof" (tname | "import" PAREN<args>) typeargs? | "import" PAREN<args> ("." IDENT)* typeargs? | "undefined"
tpltype = BRACE<type>*
tname = NAME ("." IDENT)*
tuple = (telem ("," telem)* ","?)?
telem = "..."? (IDENT "?"? ":")? type "?"?
fparams = params
typemembers = (typemember ("," | EOS))* | mapped
mapped = (("+" | "-")? "readonly")? BRACK<mappedkey> (("+" | "-")? "?")? ann ";"?
mappedkey = NAME "in" type ("as" type)?
typemember = "readonly"? (BRACK<indexsig> ann | key "?"? ann | ("get" | "set")? key "?"? generic? PAREN<params> ret | "new"? generic? PAREN<params> ret)
indexsig = NAME ":" type
tsdecl = interface | "type" NAME generic? "=" type EOS | "const"? "enum" NAME BRACE<enumbody> | "declare" (var EOS | function | class | tsdecl | "global" BRACE<module>) | ("namespace" | "module") (tname | STRING) BRACE<module> | "import" NAME "=" (tname | NAME PAREN<args>) EOS
interface = "interface" NAME generic? ("extends" types)? BRACE<typemembers>
enumbody = (enumber ("," enumber)* ","?)?
enumber = (IDENT | STRING | BRACK<assign>) ("=" assign)?
"""

_RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with"
).split()
_CONTEXT = (
    "as async await from get let of set static yield type interface namespace module declare abstract public private protected readonly override implements "
    "keyof unique infer is asserts satisfies accessor out global undefined"
).split()
_JSOPS = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @"
).split()


def _script(dialect: str, extra: str) -> Grammar:
    text = _SCRIPT
    for line in dialect.strip().split("\n"):
        old, _, new = line.partition(":=")
        old, new = old.strip(), new.strip()
        text = re.sub(r"(?<![A-Za-z])" + re.escape(old) + r"(?![A-Za-z<])", lambda _m, n=new: n, text)
    text += extra + "\nempty = (NEVER)?\njsmods = \"static\"?\n"
    # Modules are strict: these words name properties, never variables.
    strict = {"let", "static", "yield", "await", "implements", "interface", "private", "protected", "public"}
    classes = {
        "NAME": ["NAME", *(w for w in _CONTEXT if w not in strict)],
        "IDENT": ["NAME", *_CONTEXT, *_RESERVED],
        "BINOP": ["+", "-", "*", "/", "%", "**", "<<", ">>", ">>>", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "&", "|", "^", "&&", "||", "??", "in", "instanceof"],
        "PREFIX": ["!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await"],
        "POSTFIX": ["++", "--"],
        "ASSIGN": ["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="],
    }
    return Grammar(text, classes)


ECMASCRIPT = _script(_JS, "")
TYPESCRIPT = _script(_TS, _TSRULES)

# ---------------------------------------------------------------- shell

SHELL = Grammar(
    """
file = breaks? (list breaks?)?
list = andor ((sep | "&" breaks?) andor)* (";" | "&")?
sep = ";" breaks? | breaks
breaks = NL+
andor = pipeline (("&&" | "||") breaks? pipeline)*
pipeline = ("!" | "time")* command (("|" | "|&") breaks? command)*
command = simple | compound redirect* | function
simple = assign+ (redirect | assign)* | (assign | redirect)* FIRST (word | redirect | PARENS)* | redirect+
assign = ASSIGN | ARRAY
word = WORD | ASSIGN | ARRAY
redirect = REDIRECT WORD | HEREDOC
body = breaks? list breaks?
block = breaks? (list breaks?)?
compound = SHB<body> | "(" body ")" | ARITH | TEST | SHIF<ifbody> | ("while" | "until") body SHDO<body> | "for" WORD breaks? ("in" WORD* (";" | NL) breaks? | ";" breaks?)? (SHDO<body> | SHB<body>) | "for" ARITH ";"? breaks? (SHDO<body> | SHB<body>) | "select" WORD ("in" WORD* (";" | NL) breaks?)? SHDO<body> | SHCASE<casebody>
ifbody = body "then" body ("elif" body "then" body)* ("else" body)?
casebody = WORD breaks? "in" breaks? (item (ITEMEND breaks? item)* (ITEMEND breaks?)?)?
item = "("? WORD ("|" WORD)* ")" block
function = WORD "(" ")" breaks? compound redirect* | "function" WORD ("(" ")")? breaks? compound redirect*
""",
    {
        "WORD": ["WORD", "if", "then", "elif", "else", "fi", "while", "until", "do", "done", "for", "in", "case", "esac", "select", "function", "{", "}", "!", "time"],
        "FIRST": ["WORD", "in", "time"],
        "PARENS": ["NEVER"],
        "ITEMEND": [";;", ";&", ";;&"],
    },
)

# ---------------------------------------------------------------- lexers

_NUM = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b))"
_JSNUM = r"(?:0[xX](?:_?[0-9a-fA-F])+n?|0[bB](?:_?[01])+n?|0[oO](?:_?[0-7])+n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$])"
_FIN = r"(?:[^{quote}\\{{}}\n]|\\.|\{{\{{|\}}\}}|\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}})*"

_PY = re.compile(
    r"(?:[ \t\f]+|\\\r?\n)*(?:(?P<nl>\r?\n|\r)|(?P<comment>#[^\r\n]*)|"
    r"(?P<string>(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
    r"|(?<![fF])(?<![fF][rR])\"(?:[^\"\\\r\n]|\\\r?[\s\S])*\"|(?<![fF])(?<![fF][rR])'(?:[^'\\\r\n]|\\\r?[\s\S])*'))|"
    r"(?P<fstring>(?:[fF][rR]?|[rR][fF])(?:\"" + _FIN.format(quote='"') + r"\"|'" + _FIN.format(quote="'") + r"'))|"
    rf"(?P<num>{_NUM})|(?P<name>[^\W\d]\w*)|"
    r"(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|:=|->|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])|(?P<end>\Z))"
)
_PYKW = set("if elif else while for in try except finally with as def class return yield raise pass break continue import from global nonlocal del assert lambda and or not is None True False async await match case type".split())
_OPEN, _CLOSE = {"(": "PAREN", "[": "BRACK", "{": "BRACE"}, {")": "PAREN", "]": "BRACK", "}": "BRACE"}


def _columns(space: str) -> tuple[int, int]:
    wide = narrow = 0
    for c in space:
        if c == "\t":
            wide, narrow = (wide // 8 + 1) * 8, narrow + 1
        elif c == "\f":
            wide = narrow = 0
        else:
            wide, narrow = wide + 1, narrow + 1
    return wide, narrow


_FIELD = re.compile(r"\{\{|\}\}|\\.|\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}")
_NAMES = re.compile(r"\s*[^\W\d]\w*(?:\.[^\W\d]\w*)*\s*=?(?:![rsa])?(?::[^{}]*)?")


def _check_fields(literal: str, rec: Recogniser) -> None:
    """The replacement fields of a formatted string must be expressions."""
    for m in _FIELD.finditer(literal):
        field = m[1]
        if field is None or _NAMES.fullmatch(field):
            continue
        depth = end = 0
        for end, c in enumerate(field):
            depth += (c in "([{") - (c in ")]}")
            if not depth and (c == ":" or c == "!" and field[end + 1 : end + 2] != "="):
                break
        else:
            end = len(field)
        expr = field[:end].rstrip().removesuffix("=")
        if "lambda" in field or '"' in field or "'" in field:
            continue  # quotes and colons of its own: left to the exact parser
        if not rec.derives((PYTHON.names["file"],), tuple(lex_python(f"({expr})\n", rec))) or not expr.strip():
            raise Invalid


def lex_python(text: str, rec: Recogniser) -> list[int]:
    kind = PYTHON.kind
    k_nl, k_name, k_num, k_str, k_aug, k_block = kind("NL"), kind("NAME"), kind("NUMBER"), kind("STRING"), kind("AUG"), kind("BLOCK")
    words = {w: kind(w) << 1 for w in _PYKW}
    plain, k_in, k_not, k_is = k_name << 1, words["in"], words["not"], words["is"]
    ops: dict[str, int] = {}
    if "\0" in text:
        raise Invalid
    text = text.removeprefix("﻿")
    if text and not text.endswith(("\n", "\r")):
        text += "\n"
    levels: list[list[int]] = [[]]
    brackets: list[str] = []
    indents: list[tuple[int, int]] = [(0, 0)]
    blocks: list[list[int]] = []
    here = levels[0]
    at, n, fresh = 0, len(text), True
    match = _PY.match
    while at < n:
        if fresh and not brackets:
            m = re.compile(r"[ \t\f]*").match(text, at)
            at = m.end()
            if at < n and text[at] not in "\r\n#":
                col = _columns(m[0])
                top = indents[-1]
                if col == top:
                    pass
                elif col[0] > top[0] and col[1] > top[1]:
                    indents.append(col)
                    blocks.append(here)
                    here = []
                elif col[0] < top[0] and col[1] < top[1]:
                    while indents[-1] != col:
                        if indents[-1][0] <= col[0] or indents[-1][1] <= col[1]:
                            raise Invalid
                        indents.pop()
                        outer = blocks.pop()
                        outer.append(rec.fold(k_block, here) << 1)
                        here = outer
                else:
                    raise Invalid
                fresh = False
            elif at >= n:
                break
        m = match(text, at)
        if not m:
            raise Invalid
        at = m.end()
        what = m.lastgroup
        if what == "comment" or what == "end":
            continue
        if what == "nl":
            if not brackets:
                if not fresh:
                    here.append(k_nl << 1)
                fresh = True
            continue
        if what == "name":
            t = words.get(m["name"], plain)
            here.append(t)
            if t == k_in and len(here) > 1 and here[-2] == k_not:
                here[-2:] = [kind("NOTIN") << 1]
            elif t == k_not and len(here) > 1 and here[-2] == k_is:
                here[-2:] = [kind("ISNOT") << 1]
        elif what == "op":
            o = m["op"]
            if o in _OPEN:
                brackets.append(o)
                levels.append(here)
                here = []
            elif o in _CLOSE:
                if not brackets or _OPEN[brackets.pop()] != _CLOSE[o]:
                    raise Invalid
                inner, here = here, levels.pop()
                here.append(rec.fold(kind(_CLOSE[o]), inner) << 1)
            else:
                t = ops.get(o)
                if t is None:
                    t = ops[o] = (k_aug if len(o) > 1 and o[-1] == "=" and o not in ("==", "!=", "<=", ">=", ":=") else kind(o)) << 1
                here.append(t)
        elif what == "num":
            v = m["num"]
            if len(v) > 1 and v[0] == "0" and v.replace("_", "").isdigit() and v.strip("0_"):
                raise Invalid
            here.append(k_num << 1)
        else:
            if what == "fstring":
                _check_fields(m["fstring"], rec)
            here.append(k_str << 1)
    if brackets:
        raise Invalid
    if not fresh:
        here.append(k_nl << 1)
    while blocks:
        outer = blocks.pop()
        outer.append(rec.fold(k_block, here) << 1)
        here = outer
    return here


_JSTOK = re.compile(
    r"[ \t\v\f\u00a0\ufeff]*(?:(?P<nl>(?:\r\n|[\n\r\u2028\u2029])\s*)|(?P<line>//[^\n\r]*)|(?P<block>/\*[\s\S]*?\*/)|"
    r"(?P<name>[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<string>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')|"
    rf"(?P<num>{_JSNUM})|(?P<private>#[A-Za-z_$][\w$]*)|(?P<tpl>`)|"
    r"(?P<op>\?\.(?!\d)|" + "|".join(re.escape(o) for o in _JSOPS) + r")|(?P<end>\Z))"
)
_JSREGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")
_TPLTEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_DIVIDES = {"NAME", "NUMBER", "STRING", "PAREN", "BRACK", "BRACE", "TPL", "REGEX", "PRIVATE", "this", "super", "null", "true", "false", "++", "--"}


def lex_script(text: str, rec: Recogniser) -> list[int]:
    g = rec.g
    kind = g.kind
    words = {w: kind(w) for w in (*_RESERVED, *_CONTEXT)}
    k_name, k_num, k_str, k_tpl = kind("NAME"), kind("NUMBER"), kind("STRING"), kind("TPL")
    ops = {o: kind(o) for o in (*_JSOPS, "?.")}
    divides = {kind(x) for x in (*_DIVIDES, *_CONTEXT)}
    folds = {c: kind(f) for c, f in _CLOSE.items()}
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    here: list[int] = []
    stack: list[tuple[str, list[int], int]] = []
    prev, newline, at, n = 0, 0, 0, len(text)
    match = _JSTOK.match

    def template(at: int, parts: list[int]) -> int:
        """Reads template text to its end (returns after the back-tick) or to ``${``."""
        nonlocal here, prev, newline
        at = _TPLTEXT.match(text, at).end()
        if at >= n:
            raise Invalid
        if text[at] == "`":
            outer = stack.pop()
            here = outer[1]
            here.append(rec.fold(k_tpl, parts) << 1 | outer[2])
            prev, newline = k_tpl, 0
            return at + 1
        stack.append(("${", parts, 0))
        here, prev, newline = [], 0, 0
        return at + 2

    while at < n:
        m = match(text, at)
        if not m:
            raise Invalid
        what = m.lastgroup
        if what == "name":
            prev = words.get(m["name"], k_name)
            here.append(prev << 1 | newline)
            at, newline = m.end(), 0
            continue
        if what == "nl":
            newline = 1
            at = m.end()
            continue
        if what == "line" or what == "end":
            at = m.end()
            continue
        if what == "block":
            if "\n" in m["block"]:
                newline = 1
            at = m.end()
            continue
        if what == "op":
            o = m["op"]
            if o in "([{" and len(o) == 1:
                stack.append((o, here, newline))
                here, prev = [], 0
            elif o in ")]}" and len(o) == 1:
                if not stack:
                    raise Invalid
                opener, outer, flag = stack.pop()
                if opener == "${":
                    if o != "}":
                        raise Invalid
                    outer.append(rec.fold(kind("BRACE"), here) << 1)
                    at = template(m.end(), outer)
                    continue
                if _OPEN[opener] != _CLOSE[o]:
                    raise Invalid
                prev = folds[o]
                outer.append(rec.fold(prev, here) << 1 | flag)
                here = outer
            elif o[0] == "/" and prev not in divides:
                r = _JSREGEX.match(text, m.start("op"))
                if not r:
                    raise Invalid
                prev = kind("REGEX")
                here.append(prev << 1 | newline)
                at, newline = r.end(), 0
                continue
            elif o[0] == ">" and len(o) > 1 and o[1] == ">":
                # Closing type arguments look like shifts: cut into single marks there.
                prev = ops[o] if o in (">>", ">>>", ">>=", ">>>=") and g is not TYPESCRIPT else kind(">")
                if g is TYPESCRIPT:
                    prev = kind(">")
                    here.append(prev << 1 | newline)
                    at, newline = m.start("op") + 1, 0
                    continue
                here.append(prev << 1 | newline)
            else:
                prev = ops[o]
                here.append(prev << 1 | newline)
        elif what == "string":
            prev = k_str
            here.append(prev << 1 | newline)
        elif what == "num":
            prev = k_num
            here.append(prev << 1 | newline)
        elif what == "private":
            prev = kind("PRIVATE")
            here.append(prev << 1 | newline)
        else:
            stack.append(("`", here, newline))
            at = template(m.end(), [])
            continue
        at, newline = m.end(), 0
    if stack:
        raise Invalid
    return here


_JSONTOK = re.compile(
    r"(?P<ws>[ \t\r\n]+)|(?P<string>\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true|false|null)(?!\w)|(?P<op>[{}\[\],:])"
)


def lex_json(text: str, rec: Recogniser) -> list[int]:
    kind = JSON.kind
    table = {"true": kind("true") << 1, "false": kind("false") << 1, "null": kind("null") << 1, ",": kind(",") << 1, ":": kind(":") << 1}
    k_str, k_num = kind("STRING") << 1, kind("NUMBER") << 1
    here: list[int] = []
    stack: list[tuple[str, list[int]]] = []
    at, n = 0, len(text)
    while at < n:
        m = _JSONTOK.match(text, at)
        if not m:
            raise Invalid
        at = m.end()
        what = m.lastgroup
        if what == "ws":
            continue
        if what == "string":
            here.append(k_str)
        elif what == "num":
            here.append(k_num)
        elif what == "word" or m[0] in ",:":
            here.append(table[m[0]])
        elif m[0] in _OPEN:
            stack.append((m[0], here))
            here = []
        else:
            if not stack or _OPEN[stack[-1][0]] != _CLOSE[m[0]]:
                raise Invalid
            outer = stack.pop()[1]
            outer.append(rec.fold(kind(_CLOSE[m[0]]), here) << 1)
            here = outer
    if stack:
        raise Invalid
    return here


_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_TOMLTOK = re.compile(
    r"(?P<ws>[ \t]+)|(?P<nl>\r?\n)|(?P<comment>#[^\r\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)|"
    r"(?P<multi>\"\"\"(?:[^\"\\]|\\(?:[btnfre\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n)|\"{1,2}(?!\"))*\"{3,5}|'''(?:[^']|'{1,2}(?!'))*'{3,5})|"
    r"(?P<string>\"(?:[^\"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'[^'\x00-\x08\x0a-\x1f\x7f]*')|"
    rf"(?P<scalar>(?:{_DATE}|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|true|false)(?![\w.+:-]))|"
    r"(?P<bare>[A-Za-z0-9_-]+)|(?P<op>[\[\]{}=,.])"
)


def lex_toml(text: str, rec: Recogniser) -> list[int]:
    kind = TOML.kind
    here: list[int] = []
    stack: list[tuple[str, list[int]]] = []
    text = text.removeprefix("﻿")
    if not text.endswith("\n"):
        text += "\n"
    at, n = 0, len(text)
    while at < n:
        m = _TOMLTOK.match(text, at)
        if not m:
            raise Invalid
        at = m.end()
        what = m.lastgroup
        if what in ("ws", "comment"):
            continue
        if what == "nl":
            here.append(kind("NL") << 1)
        elif what == "multi":
            here.append(kind("MULTI") << 1)
        elif what == "string":
            here.append(kind("STRING") << 1)
        elif what == "scalar":
            plain = re.fullmatch(r"[A-Za-z0-9_-]+", m[0])
            here.append(kind("BARE_SCALAR" if plain else "SCALAR") << 1)
        elif what == "bare":
            here.append(kind("BARE") << 1)
        elif m[0] in _OPEN:
            stack.append((m[0], here))
            here = []
        elif m[0] in _CLOSE:
            if not stack or _OPEN[stack[-1][0]] != _CLOSE[m[0]]:
                raise Invalid
            outer = stack.pop()[1]
            outer.append(rec.fold(kind(_CLOSE[m[0]]), here) << 1)
            here = outer
        else:
            here.append(kind(m[0]) << 1)
    if stack:
        raise Invalid
    return here


_SHOP = re.compile(r"&&|\|\||;;&|;;|;&|\|&|&>>|&>|<<-|<<<|<<|>>|<&|>&|<>|>\||[;&|()<>]")
_SHWORDS = set("if then elif else fi while until do done for in case esac select function { } ! time".split())


def _quoted(text: str, at: int, rec: Recogniser) -> int:
    """The end of a double-quoted string that starts at ``at`` (after its quote)."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == '"':
            return at + 1
        if c == "\\":
            at += 2
        elif c == "$" or c == "`":
            at = _expansion(text, at, rec)
        else:
            at += 1
    raise Invalid


def _expansion(text: str, at: int, rec: Recogniser) -> int:
    """The end of a ``$`` or back-tick expansion; commands within are checked too."""
    n = len(text)
    if text[at] == "`":
        end = at + 1
        while end < n and text[end] != "`":
            end += 2 if text[end] == "\\" else 1
        if end >= n:
            raise Invalid
        return end + 1
    if text.startswith("$((", at):
        depth, end = 2, at + 3
        while end < n and depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        if depth:
            raise Invalid
        return end
    if text.startswith("$(", at):
        end = _command_end(text, at + 2, rec)
        inner = text[at + 2 : end]
        if not rec.derives((SHELL.names["file"],), tuple(lex_shell(inner, rec))):
            raise Invalid
        return end + 1
    if text.startswith("${", at):
        depth, end = 1, at + 2
        while end < n and depth:
            c = text[end]
            if c == "\\":
                end += 2
                continue
            if c == "'" and depth == 1 and '"' not in text[at:end]:
                close = text.find("'", end + 1)
                end = close + 1 if close > 0 else end + 1
                continue
            if c == '"':
                end = _quoted(text, end + 1, rec)
                continue
            if c == "$" and text[end + 1 : end + 2] in ("{", "("):
                end = _expansion(text, end, rec)
                continue
            depth += (c == "{") - (c == "}")
            end += 1
        if depth:
            raise Invalid
        return end
    return at + 1


def _command_end(text: str, at: int, rec: Recogniser) -> int:
    """The closing bracket of a command substitution."""
    n, depth, cases = len(text), 0, 0
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "'":
            at = text.find("'", at + 1) + 1
            if not at:
                raise Invalid
        elif c == '"':
            at = _quoted(text, at + 1, rec)
        elif c == "$" and text[at + 1 : at + 2] in ("(", "{") or c == "`":
            at = _expansion(text, at, rec)
        elif c == "(":
            depth, at = depth + 1, at + 1
        elif c == ")":
            if not depth and not cases:
                return at
            if depth:
                depth -= 1
            at += 1
        elif c.isalpha() and (m := re.compile(r"\w+").match(text, at)):
            cases += (m[0] == "case") - (m[0] == "esac")
            at = m.end()
        else:
            at += 1
    raise Invalid


def lex_shell(text: str, rec: Recogniser) -> list[int]:
    kind = SHELL.kind
    words = {w: kind(w) << 1 for w in _SHWORDS}
    opening = {"{": ("SHB", "}"), "do": ("SHDO", "done"), "if": ("SHIF", "fi"), "case": ("SHCASE", "esac")}
    closing = {"}", "done", "fi", "esac"}
    starts = {0, *(kind(x) for x in ("NL", ";", "&", "&&", "||", "|", "|&", "(", ";;", ";&", ";;&", "then", "else", "elif", "while", "until", "!", ")", "SHDO"))}
    stack: list[tuple[str, list[int]]] = []
    out: list[int] = []
    waiting: list[tuple[str, bool]] = []
    at, n = 0, len(text)
    in_test = False
    while at < n:
        c = text[at]
        if c in " \t" or text.startswith("\\\n", at) or text.startswith("\\\r\n", at):
            at += 1 if c in " \t" else 2
            continue
        if c == "\r":
            at += 1
            continue
        if c == "\n":
            at += 1
            if waiting:
                for word, dashed in waiting:
                    while True:
                        end = text.find("\n", at)
                        line = text[at : end if end >= 0 else n]
                        at = end + 1 if end >= 0 else n
                        if (line.lstrip("\t") if dashed else line).rstrip("\r") == word or at >= n:
                            break
                waiting = []
            if not in_test:
                out.append(kind("NL") << 1)
            continue
        if c == "#":
            end = text.find("\n", at)
            at = end if end >= 0 else n
            continue
        first = not out or out[-1] >> 1 in starts
        if text.startswith("((", at) and (first or (out and out[-1] == words["for"])):
            end, depth = at + 2, 2
            while end < n and depth:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            if not depth and text[end - 2 : end] == "))":
                out.append(kind("ARITH") << 1)
                at = end
                continue
        if in_test and text.startswith("]]", at):
            in_test = False
            out.append(kind("TEST") << 1)
            at += 2
            continue
        m = _SHOP.match(text, at)
        if m and (in_test or not text.startswith(("<(", ">("), at)):
            o = m[0]
            at = m.end()
            if in_test:
                if o in (";", "&", ";;"):
                    raise Invalid
                continue
            if o in ("<<", "<<-"):
                w = re.compile(r"[ \t]*(?:'([^'\n]*)'|\"([^\"\n]*)\"|\\?([^\s;&|<>()'\"]+))").match(text, at)
                if not w:
                    raise Invalid
                waiting.append((next(g for g in w.groups() if g is not None), o == "<<-"))
                at = w.end()
                out.append(kind("HEREDOC") << 1)
            elif o in ("<", ">", ">>", "<<<", "<&", ">&", "<>", ">|", "&>", "&>>"):
                if out and out[-1] == kind("WORD") << 1 and m.start() and re.search(r"(?:^|[\s;&|(])(?:\d+|\{\w+\})$", text[max(0, m.start() - 12) : m.start()]):
                    out.pop()
                out.append(kind("REDIRECT") << 1)
            else:
                out.append(kind(o) << 1)
            continue
        start = at
        array = False
        while at < n:
            c = text[at]
            if c in " \t\n\r" or c in ";&|()" or c in "<>":
                if c == "(" and re.fullmatch(r"\w+(?:\[[^\]]*\])?\+?=", text[start:at]):
                    array = True
                    depth, at = 1, at + 1
                    while at < n and depth:
                        c = text[at]
                        if c == "'":
                            at = text.find("'", at + 1) + 1
                            if not at:
                                raise Invalid
                            continue
                        if c == '"':
                            at = _quoted(text, at + 1, rec)
                            continue
                        if c == "$":
                            at = _expansion(text, at, rec)
                            continue
                        depth += (c == "(") - (c == ")")
                        at += 1
                    if depth:
                        raise Invalid
                    continue
                if c in "<>" and text[at + 1 : at + 2] == "(" and at == start:
                    at = _command_end(text, at + 2, rec) + 1
                    continue
                if c == "(" and at > start and text[at - 1] in "?*+@!":
                    close = text.find(")", at)
                    if close < 0:
                        raise Invalid
                    at = close + 1
                    continue
                break
            if c == "\\":
                at += 2
            elif c == "'":
                at = text.find("'", at + 1) + 1
                if not at:
                    raise Invalid
            elif c == '"':
                at = _quoted(text, at + 1, rec)
            elif c == "$" and text[at + 1 : at + 2] == "'":
                at += 2
                while at < n and text[at] != "'":
                    at += 2 if text[at] == "\\" else 1
                if at >= n:
                    raise Invalid
                at += 1
            elif c in "$`":
                at = _expansion(text, at, rec)
            else:
                at += 1
        word = text[start : min(at, n)]
        if in_test:
            continue
        if word == "[[" and first:
            in_test = True
        elif word in opening and (first and not (stack and stack[-1][0] == "esac" and not out)):
            stack.append((opening[word][1], out))
            out = []
        elif word in closing and (first or (stack and word == stack[-1][0] and out and out[-1] >> 1 >= Recogniser.FOLD)):
            if not stack or stack[-1][0] != word:
                raise Invalid
            name = {"}": "SHB", "done": "SHDO", "fi": "SHIF", "esac": "SHCASE"}[word]
            inner, out = out, stack.pop()[1]
            out.append(rec.fold(kind(name), inner) << 1)
        elif word in words:
            out.append(words[word])
        elif array:
            out.append(kind("ARRAY") << 1)
        elif re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=", word):
            out.append(kind("ASSIGN") << 1)
        else:
            out.append(kind("WORD") << 1)
    if in_test or stack:
        raise Invalid
    return out


#: By language: its grammar, lexer and the start rules of its dialects, which run together.
LANGUAGES = {
    "python": (PYTHON, lex_python, ("file",)),
    "javascript": (ECMASCRIPT, lex_script, ("module",)),
    "typescript": (TYPESCRIPT, lex_script, ("module",)),
    "json": (JSON, lex_json, ("value",)),
    "toml": (TOML, lex_toml, ("file",)),
    "shell": (SHELL, lex_shell, ("file",)),
}


# ---------------------------------------------------------------- cutting into sentences


def _kind_of(t: int, rec: Recogniser) -> int:
    return rec.folded[(t >> 1) - Recogniser.FOLD][0] if t >> 1 >= Recogniser.FOLD else t >> 1


def cut_python(tokens: tuple[int, ...], rec: Recogniser) -> list[tuple[int, ...]]:
    kind = PYTHON.kind
    ends, at = (kind("NL"), kind("BLOCK")), kind("@")
    goes_on = {kind(x) for x in ("BLOCK", "else", "elif", "except", "finally")}
    out, start, prev = [], 0, 0
    for i, t in enumerate(tokens):
        k = _kind_of(t, rec)
        if i and prev in ends and k not in goes_on and not (prev == ends[0] and tokens[start] >> 1 == at):
            out.append(tokens[start:i])
            start = i
        prev = k
    out.append(tokens[start:])
    return out


def _cut_script(grammar: Grammar):
    kind = grammar.kind
    brace, semi = kind("BRACE"), kind(";")
    fresh = {kind(x) for x in "NAME if for while do switch try return throw const let var function class import export async await this interface type static declare enum get set break continue abstract public private protected readonly".split()}

    def cut(tokens: tuple[int, ...], rec: Recogniser) -> list[tuple[int, ...]]:
        out, start, prev = [], 0, 0
        for i, t in enumerate(tokens):
            k = _kind_of(t, rec)
            if i and (prev == semi or prev == brace and t & 1 and k in fresh):
                out.append(tokens[start:i])
                start = i
            prev = k
        out.append(tokens[start:])
        return [(p[0] & ~1, *p[1:]) for p in out]

    return cut


def cut_lines(grammar: Grammar):
    nl = grammar.kind("NL")

    def cut(tokens: tuple[int, ...], rec: Recogniser) -> list[tuple[int, ...]]:
        out, start = [], 0
        for i, t in enumerate(tokens):
            if i > start and tokens[i - 1] >> 1 == nl and t >> 1 != nl:
                out.append(tokens[start:i])
                start = i
        out.append(tokens[start:])
        return out

    return cut


#: By language: the rules closed under joining, and how their sequences are cut.
CUTS = {
    "python": (("file", "stmts"), cut_python),
    "javascript": (("module", "stmts", "members"), _cut_script(ECMASCRIPT)),
    "typescript": (("module", "stmts", "members", "typemembers"), _cut_script(TYPESCRIPT)),
    "toml": (("file",), cut_lines(TOML)),
    "shell": (("file", "body"), cut_lines(SHELL)),
}
