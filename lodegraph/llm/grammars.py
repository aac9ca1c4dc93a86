"""The local grammars of Rust, JavaScript, TypeScript and Go, over strings in which a bracketed group is one character.

A group's character tells as what the group is valid (its roles): a ``{}`` may
be a block, the fields of a struct, the arms of a match. The roles of a group
depend on what it holds alone, so groups reduce in any order. Rules whose names
end in ``@`` stand for several, one for each variant that ``_vary`` is given.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lodegraph.llm import lexing
from lodegraph.llm.peg import END, Rules

#: First character of the groups of each bracket; the bits of the rest are roles.
BASE = {"(": 0xE000, "[": 0xE400, "{": 0xE800, lexing.SUB_OPEN: 0xF800}


@dataclass
class Grammar:
    """roles: for each opening bracket, rule names by bit. ``tidy`` is applied to what a group or the whole text holds, with the bracket ('' for the text)."""

    roles: dict[str, list[str]]
    text: str
    tokens: dict[str, str]
    sets: dict[str, str]
    start: str
    tidy: object = None
    rules: Rules = field(init=False)

    def __post_init__(self) -> None:
        sets = {n: frozenset(c) for n, c in self.sets.items()}
        for bracket, names in self.roles.items():
            every = range(1 << len(names))
            for k, name in enumerate(names):
                sets["$" + name] = frozenset(chr(BASE[bracket] + m) for m in every if m >> k & 1)
            sets["$any" + {"(": "paren", "[": "square", "{": "brace"}.get(bracket, "sub")] = frozenset(chr(BASE[bracket] + m) for m in every)
        sets["$any"] = frozenset(c for n in sets if n.startswith("$any") for c in sets[n])
        self.rules = Rules(self.text, self.tokens | {END: END}, sets | {"END": frozenset(END)})


def _vary(text: str, variants: dict[str, dict[str, str]], mark: str = "@") -> str:
    """Each rule with the mark after a name once for each variant; {X} in it gives what the variant says."""
    out = []
    for rule in re.findall(r"^\w+[@%]? =.*(?:\n[ \t]+.*)*", text, re.M):
        if not re.search(rf"\w{mark}", rule):
            out.append(rule)
            continue
        for name, words in variants.items():
            one = rule
            for k, v in words.items():
                one = one.replace("{" + k + "}", v)
            out.append(re.sub(rf"(?<=\w){mark}", name, one))
    return "\n".join(out)


# --- Rust -------------------------------------------------------------------

_RUST = r"""
file = inner* item*
inner = INNERDOC | '#' '!' $attrbody
attr = DOC | '#' $attrbody
item = attr* (vis? itembody | macroitem)
macroitem = path '!' ID? ($anybrace ';'? | ($anyparen | $anysquare) ';')
vis = 'pub' $visp?
itembody = 'use' usetree ';'
  | 'mod' ID (';' | $items)
  | 'extern' 'crate' (ID | 'self') ('as' (ID | '_'))? ';'
  | quals 'fn' ID generics? $params result? where? $block
  | 'unsafe'? 'extern' STR? $foreign
  | typeitem
  | 'struct' ID generics? (where? $fields | where? ';' | $tfields where? ';')
  | 'union' ID generics? where? $fields
  | 'enum' ID generics? where? $variants
  | constitem
  | 'static' 'mut'? ID ':' type ('=' expr)? ';'
  | 'const'? 'unsafe'? 'auto'? 'trait' ID generics? (':' bounds?)? (where? $assoc | '=' bounds? where? ';')
  | 'default'? 'unsafe'? 'impl' generics? 'const'? ('!' !$assoc)? type ('for' type)? where? $assoc
typeitem = 'type' ID generics? (':' bounds?)? where? ('=' type)? where? ';'
constitem = 'const' ('_' | ID) ':' type ('=' expr)? ';'
quals = ('const' | 'async' | 'unsafe' | 'safe' | 'default' | 'extern' STR?)*
result = '->' type
foreign = inner* (attr* (vis? (quals 'fn' ID generics? $params result? where? ';' | 'safe'? 'unsafe'? 'static' 'mut'? ID ':' type ';' | typeitem) | macroitem))*
assoc = inner* (attr* (vis? 'default'? (quals 'fn' ID generics? $params result? where? ($block | ';') | constitem | typeitem) | macroitem))*
items = inner* item*
usetree = '::'? (usetail | useseg ('::' useseg)* ('::' usetail | 'as' (ID | '_'))?)
usetail = '*' | $uses
useseg = ID | 'self' | 'super' | 'crate' | 'Self'
uses = (usetree (',' usetree)* ','?)?
visp = 'crate' | 'self' | 'super' | 'in' path
generics = LT (gparam (',' gparam)* ','?)? GT
gparam = attr* (LIFE (':' (LIFE ('+' LIFE)* '+'?)?)? | 'const' ID ':' type ('=' constarg)? | ID (':' bounds?)? ('=' type)?)
where = 'where' (wpred (',' wpred)* ','?)?
wpred = LIFE ':' (LIFE ('+' LIFE)*)? | forlt? type ':' bounds?
bounds = bound ('+' bound)* '+'?
bound = LIFE | $types | 'use' LT (garg (',' garg)* ','?)? GT | '~'? 'const'? 'async'? '?'? forlt? path
forlt = 'for' generics
type = typenb ('+' bounds)?
typenb = ('&' | '&&') LIFE? 'mut'? typenb | '*' ('const' | 'mut') typenb | $types | $arrty | '!' | '_'
  | ('impl' | 'dyn') bounds | forlt? quals 'fn' $ftypes ('->' typenb)? | forlt path | path ('!' $any)? | qself ('::' seg)+
qself = LT type ('as' path)? GT
path = '::'? seg ('::' seg)*
seg = PATHID ('::'? gargs | '::'? $types ('->' typenb)?)?
gargs = LT (garg (',' garg)* ','?)? GT
garg = LIFE | type &(',' | GT) | ID gargs? ('=' (type | constarg) | ':' bounds) | constarg
constarg = '-'? LIT | $block
types = bounds &END | (type (',' type)* ','?)?
ftypes = (ftype (',' ftype)* ','?)?
ftype = attr* ('...' | (ID | '_') ':' '...' | ('mut'? (ID | '_') ':')? type)
arrty = type (';' expr)?
params = (param (',' param)* ','?)?
param = attr* (('&' LIFE?)? 'mut'? 'self' (':' type)? | pat ':' ('...' | type) | '...')
tfields = (tfield (',' tfield)* ','?)?
tfield = attr* vis? type
fields = (fielddef (',' fielddef)* ','?)?
fielddef = attr* vis? ID ':' type ('=' expr)?
variants = (variant (',' variant)* ','?)?
variant = attr* vis? ID ($fields | $tfields)? ('=' expr)?
attrbody = 'unsafe' $anyparen | pathexpr ($any | '=' expr)?
pat = '|'? patone ('|' patone)*
patone = attr* (patbound RANGE patbound? | RANGE patbound | '..' | '-'? LIT | pathexpr ($pats | $spat | '!' $any)
  | 'ref'? 'mut'? ID !'::' ('@' patone)? | qself ('::' (PATHID | gargs))+ ($pats | $spat)? | pathexpr | '_' | ('&' | '&&') 'mut'? patone | $pats | $slicepat | 'const' $block)
patbound = '-'? LIT | qself ('::' PATHID)+ | pathexpr
pats = (pat (',' pat)* ','?)?
slicepat = (pat (',' pat)* ','?)?
spat = (spatone (',' spatone)* ','?)?
spatone = attr* ('..' | (ID | NUM) ':' pat | 'ref'? 'mut'? ID)
slit = (slitone (',' slitone)* ','?)? (attr* '..' expr?)?
slitone = attr* (ID | NUM) (':' expr)?
args = (attr* expr (',' attr* expr)* ','?)?
array = attr* expr ';' expr | (attr* expr (',' attr* expr)* ','?)?
index = expr
arms = inner* (attr* pat ('if' guard)? '=>' armbody)*
guard = expr &'=>' | cond
armbody = attr* (blocklike !('.' | '?' | BINARY) ','? | expr (',' | &END))
block = inner* stmt*
stmt = ';' | attr* 'let' pat (':' type)? ('=' expr ('else' $block)?)? ';' | item !('.' | '?') | attr* (blocklike !('.' | '?') | path '!' $anybrace !('.' | '?' | BINARY) | expr (';' | &END))
blocklike = 'unsafe' $block | 'async' 'move'? $block | 'const' $block | (LIFE ':')? ('loop' $block | 'while' cond $block | 'for' pat 'in' exprN $block | $block)
  | 'if' cond $block ('else' 'if' cond $block)* ('else' $block)? | 'match' exprN $arms
cond = (letcond | cmpN) (('&&' | '||') (letcond | cmpN))* !('=' | OPASSIGN | '..' | '..=') | exprN
letcond = 'let' pat '=' (cmpN (('..' | '..=') cmpN)?)
expr@ = range@ (('=' | OPASSIGN | '> glued' '> glued' '=') range@)*
range@ = '..=' or@ | '..' ({OPEN} or@)? | or@ ('..=' or@ | '..' ({OPEN} or@)?)?
or@ = cmp@ (('&&' | '||') cmp@)*
cmp@ = arith@ (('<' | '> glued' '=' | '>' | '==' | '!=' | '<=') arith@)?
arith@ = unary@ ((ARITH | '< glued' '<' | '> glued' '>') unary@)*
unary@ = ('-' | '!' | '*' | ('&' | '&&') ('raw' ('const' | 'mut') | 'mut')?)* attr* postfix@ ('as' typenb)*
postfix@ = primary@ ('?' | '.' ('await' | NUM | ID ('::' gargs)? $args?) | $args | $index)*
primary@ = LIT | pathexpr ({SLIT} | '!' $any)? | qself ('::' (PATHID | gargs))+ {SLIT2} | $args | $array | blocklike
  | 'return' expr@? | 'break' LIFE? expr@? | 'continue' LIFE? | closure@ | '_'
closure@ = forlt? 'static'? 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' typenb $block | expr@)
cparam = attr* patone (':' type)?
pathexpr = '::'? PATHID ('::' (PATHID | gargs))*
"""
_R = lexing.RUST
_RUST_IDS = "i" + "".join(_R[w] for w in lexing.RUST_LOOSE.split())
RUST = Grammar(
    {"(": ["args", "params", "types", "ftypes", "tfields", "pats", "visp"], "[": ["array", "index", "arrty", "slicepat", "attrbody"], "{": ["block", "items", "fields", "variants", "arms", "slit", "spat", "uses", "assoc", "foreign"]},
    _vary(_RUST, {"": {"SLIT": "$slit", "SLIT2": "$slit?", "OPEN": ""}, "N": {"SLIT": "NONE", "SLIT2": "", "OPEN": "!$anybrace"}}),
    _R,
    {
        "ID": _RUST_IDS, "PATHID": _RUST_IDS + "".join(_R[w] for w in ("self", "Self", "super", "crate")), "NONE": "", "LIT": "ns", "NUM": "n", "STR": "s", "LIFE": _R["lifetime name"], "DOC": _R["doc comment"], "INNERDOC": _R["inner doc comment"],
        "LT": "<" + _R["< glued"], "GT": ">" + _R["> glued"], "OPASSIGN": _R["op="], "ARITH": "+-*/%^&|", "RANGE": _R[".."] + _R["..="] + _R["..."],
        "BINARY": "+/%^=|" + "".join(_R[w] for w in ("==", "!=", "op=", "> glued", "<=", "as", "..", "..=")),
    },
    "file",
)


# --- JavaScript and TypeScript ----------------------------------------------

_SCRIPT = r"""
program = top
top = (import | deco* export | stmtT)*
block = stmt*
tblock = stmtT*
cases = case*
case = ('case' expr ':' | 'default' ':') stmt*
tcases = tcase*
tcase = ('case' expr ':' | 'default' ':') stmtT*
nl = NL | WNL
end = ';' | NL | WNL | &END
stmt@ = ';' | NL | WNL | {BLOCK} | decl | vars end | 'if' $expr nl? stmt@ nl? ('else' nl? stmt@)? | 'for' 'await'? $forhead nl? stmt@ | 'while' $expr nl? stmt@
  | 'do' nl? stmt@ nl? 'while' $expr ';'? | 'switch' $expr nl? {CASES} | 'try' nl? {BLOCK} nl? ('catch' $catchparam? nl? {BLOCK} nl? ('finally' nl? {BLOCK})? | 'finally' nl? {BLOCK})
  | {RETURN} | 'throw' expr end | ('break' | 'continue') ID? end | 'debugger' end | ID ':' nl? stmt@ | 'with' $expr nl? stmt@ | !($anybrace | 'function' | 'class') expr end
decl = 'async'? 'function' '*'? ID sig | 'async'? 'function' ID tssig | deco* 'class' ID classrest | tsdecl
sig = typarams? WNL? $params ret? nl? $block
classrest = typarams? ('extends' lhs typeargs?)? implements? nl? $classbody
deco = '@' (ID | $expr) ('.' IDNAME)* typeargs? $args? nl?
vars = ('var' | 'let' | 'await'? 'using' !NL &ID) vardecl (',' vardecl)* | 'const' constdecl (',' constdecl)*
vardecl = ID definite? ann? ('=' assign)? | ($pattern | $apattern) ann? ('=' assign | ambient)
constdecl = binding ann? ('=' assign | ambient)
binding = ID | $pattern | $apattern
forhead = ('var' | 'let' | 'const' | 'await'? 'using' &ID) binding ann? ('of' assign | 'in' expr) | ($pattern | $apattern | lhs) ('of' assign | 'in' expr) | (vars | expr)? ';' expr? ';' expr?
catchparam = binding ann?
expr = assign (',' assign)*
assign% = arrow% | 'yield' ('*'? assign%)? | ($pattern | $apattern) '=' assign% | !((NUM | STR) '=') lhs ('=' | OPASSIGN | '> glued' '> glued' '> glued'? '=') assign% | cond%
arrow% = 'async'? (typarams? $params {RET} | ID) '=>' ($block | !$anybrace assign% | $object &NONE)
cond% = binary ('?' (assign ':' assign% | assignQ ':' assign%))?
binary = unary (binop unary | tsas)*
binop = WNL? ('*' | '<') | BINOP | '>' NL? | '> glued' ('> glued'? '>' | '=') | 'in' | 'instanceof'
unary = ('!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' | tsassert)* lhs ('++' | '--')?
lhs = ('new' '.' ID | newexpr | 'super' &('.' | $index | $args) | 'import' ($args | '.' ID) | primary) post*
post = '.' (IDNAME | PRIV) | '?.' (IDNAME | PRIV | typeargs? $args | $index | templ) | WNL? ($args | $index | templ) | nonnull | typeargs ($args | templ | &INSTEND)
newexpr = 'new' (newexpr | primary | 'super' | 'import' '.' ID) ('.' (IDNAME | PRIV) | $index | templ | nonnull)* typeargs? (WNL? $args)?
templ = $sub* TEMPLATE
primary = 'async'? 'function' '*'? ID? sig | ID | NUM | STR | REGEX | LITWORD | templ | PRIV &'in' | $expr | $array | $object | deco* 'class' ID? classrest
params = (param (',' param)* ','?)?
param = deco* (PMOD &(ID | $pattern | $apattern))* ('this' ann | '...'? binding opt? ann? ('=' assign)?)
args = ('...'? assign (',' '...'? assign)* ','?)?
array = item? (',' item?)*
item = '...'? assign
index = expr
apattern = pitem? (',' pitem?)*
pitem = '...' target | target ('=' assign)?
target = $pattern !POST | $apattern !POST | lhs
object = (prop (',' prop)* ','?)?
prop = '...' assign | ('get' | 'set') propname $params ret? nl? $block | 'async' '*'? propname sig | '*'? propname sig | propname ':' assign | ID
propname = IDNAME | STR | NUM | $index
pattern = (pprop (',' pprop)* ','?)?
pprop = '...' lhs | propname ':' target ('=' assign)? | ID ('=' assign)?
classbody = (';' | NL | WNL | deco | 'static' nl? $tblock | (CMOD nl? &(propname | PRIV | '*' | $indexsig))* member)*
member = ('get' | 'set') name $params ret? nl? ($block | tsend) | 'async' '*'? name method | '*' name method | name opt? method | name (opt | definite)? ann? ('=' assign)? end | tsindex
name = propname | PRIV
method = typarams? $params ret? (nl? $block | tsend)
specs = (spec (',' spec)* ','?)?
spec = typekw? (IDNAME | STR) ('as' (IDNAME | STR))?
import = 'import' (clause nl? 'from' STR | STR | typekw clause nl? 'from' STR) attributes? end | importeq
clause = ID (',' ('*' 'as' ID | $specs))? | '*' 'as' ID | $specs
attributes = ('with' | ID) $object
export = 'export' ('default' (deco* 'class' ID? classrest | 'async'? 'function' '*'? ID? (sig | tssig) | tsdefault | !('function' | 'class') assign end)
  | '*' ('as' (IDNAME | STR))? 'from' STR attributes? end | $specs ('from' STR attributes?)? end | decl | vars end | exportts)
sub = expr
"""
_PLAIN_STUBS = "\n".join(f"{n} = NONE" for n in "tssig tsdecl typarams typeargs implements definite ann ret ambient tsas tsassert nonnull opt tsend tsindex typekw importeq tsdefault exportts".split())
_TYPES = r"""
tssig = typarams? $params ret? end
tsdecl = 'declare' (tsdecl | decl | vars end) | 'abstract' 'class' ID classrest | 'interface' ID typarams? ('extends' type (',' type)*)? nl? $tlit | 'type' ID typarams? '=' type end
  | 'const'? 'enum' ID nl? $enumbody | ('namespace' | 'module') (ID ('.' ID)* | STR) (nl? $moditems | end) | 'global' nl? $moditems
typarams = '<' typaram (',' typaram)* ','? GT
typaram = (TPMOD &(ID | TPMOD))* ID ('extends' type)? ('=' type)?
typeargs = '<' (type (',' type)* ','?)? GT
implements = 'implements' type (',' type)*
definite = '!'
ann = ':' type
ret = ':' rettype
rettype = 'asserts' (ID | 'this') ('is' type)? !('.' | '[' | '|') | (ID | 'this') 'is' type | type
ambient = &(',' | ';' | NL | WNL | END)
tsas = ('as' | 'satisfies') ('const' | type)
tsassert = '<' (type | 'const') GT
nonnull = '!'
opt = '?'
tsend = end
tsindex = $indexsig ann end
typekw = 'type' &(IDNAME | STR | $specs | '*')
importeq = 'import' typekw? ID '=' (ID $args | ID ('.' ID)*) end
tsdefault = 'abstract' 'class' ID? classrest | 'interface' ID typarams? ('extends' type (',' type)*)? nl? $tlit
exportts = '=' expr end | 'as' 'namespace' ID end | importeq | typekw ('*' ('as' (IDNAME | STR))? 'from' STR | $specs ('from' STR)?) end
type = function | union ('extends' (function | union) '?' type ':' type)?
function = ('abstract'? 'new')? typarams? $params '=>' rettype
union = '|'? both ('|' (function | both))*
both = '&'? opty ('&' opty)*
opty = ('keyof' | 'unique' | 'readonly')* ('infer' ID ('extends' opty)? | simple $tindex*)
simple = $tsub* TEMPLATE | STR | '-'? NUM | TYPEWORD | 'typeof' ('import' $args ('.' IDNAME)* | (ID | 'this') ('.' (IDNAME | PRIV))*) typeargs? | 'import' $args ('.' IDNAME)* typeargs? | $tlit | $tuple | $ptype | ID ('.' IDNAME)* typeargs?
ptype = type
tindex = type?
tuple = (element (',' element)* ','?)?
element = '...'? ID '?'? ':' type | '...'? type '?'?
indexsig = ID ':' type
mapped = ID 'in' type ('as' type)?
tlit = (tmember (';' | ',' | NL | WNL | &END))*
tmember = ('+' | '-')? 'readonly'? $mapped (('+' | '-')? '?')? ann? | 'readonly'? $indexsig ann | ('get' | 'set') propname $params ret? | 'new' typarams? $params ret? | typarams? $params ret?
  | 'readonly' propname '?'? (typarams? $params ret? | ann?) &TEND | propname '?'? (typarams? $params ret? | ann?)
enumbody = (entry (',' entry)* ','?)?
entry = (IDNAME | STR | $index) ('=' assign)?
moditems = top
tsub = type
"""
_J = lexing.JS
_JS_IDS = "i" + "".join(_J[w] for w in lexing.JS_LOOSE.split() if w != "await")
_WORDS = "i" + "".join(_J[w] for w in f"{lexing.JS_STRICT} {lexing.JS_LOOSE}".split())
_LITS = "".join(_J[w] for w in "this null true false".split())
_VARIANTS = {"": {"BLOCK": "$block", "CASES": "$cases", "RETURN": "'return' expr? end"}, "T": {"BLOCK": "$tblock", "CASES": "$tcases", "RETURN": "NONE"}}


def _script_text(own: str) -> str:
    return _vary(_vary(_SCRIPT, _VARIANTS), {"": {"RET": "ret?"}, "Q": {"RET": ""}}, "%") + "\n" + own


def _tidy_script() -> object:
    groups = "-"
    esc = lambda chars: "".join(map(re.escape, chars))
    ends = _WORDS.translate({ord(_J[w]): None for w in "function class const var if else for while do switch case throw new typeof delete instanceof in try finally import export extends await".split()})
    ends += "ns>!" + _J["private name"] + _J["regex literal"] + _J["template literal"] + _J["++"] + _J["--"]
    starts = _WORDS.translate({ord(_J[w]): None for w in "instanceof in extends implements".split()}) + "ns!~@" + _J["private name"] + _J["regex literal"] + _J["++"] + _J["--"]
    braces, weak = "-", "--*<" + esc(_J["template literal"])
    drop = re.compile(rf"(?<![{esc(ends)}{groups}\n])\n+|\n+(?![{esc(starts)}{braces}{weak}\n])")
    runs, soft = re.compile(r"\n\n+"), re.compile(rf"\n(?=[{weak}])")
    member = re.compile(rf"(?<=[.{_J['?.']}])[{esc(_WORDS)}]")

    def tidy(s: str, bracket: str) -> str:
        if "\n" not in s:
            return s
        if bracket not in ("{", ""):
            return s.replace("\n", "")
        return soft.sub("\r", drop.sub("", runs.sub("\n", member.sub("i", s))))

    return tidy


def _script(own: str, roles: dict[str, list[str]], cmod: str, pmod: str) -> Grammar:
    return Grammar(
        roles, _script_text(own), _J,
        {
            "ID": _JS_IDS, "IDNAME": _WORDS, "NUM": "n", "STR": "s", "REGEX": _J["regex literal"], "TEMPLATE": _J["template literal"], "PRIV": _J["private name"], "LITWORD": _LITS, "NL": "\n", "WNL": "\r", "NONE": "", "OPASSIGN": _J["op="],
            "BINOP": "+-/%&|^" + "".join(_J[x] for x in "?? && || ** == != === !== <= <<".split()), "GT": ">" + _J["> glued"], "TYPEWORD": _LITS + _J["void"], "TPMOD": _J["const"] + _J["in"] + _J["out"], "POST": "." + _J["?."],
            "INSTEND": ";,:\n\r?" + END + "=", "TEND": ";,\n\r" + END, "CMOD": "".join(_J[w] for w in cmod.split()), "PMOD": "".join(_J[w] for w in pmod.split()),
        },
        "program", _tidy_script(),
    )


_JS_ROLES = {"(": ["expr", "args", "params", "forhead", "catchparam"], "[": ["array", "index", "apattern"], "{": ["block", "tblock", "cases", "tcases", "object", "pattern", "classbody", "specs"], lexing.SUB_OPEN: ["sub"]}
_TS_ROLES = {"(": [*_JS_ROLES["("], "ptype"], "[": [*_JS_ROLES["["], "tindex", "tuple", "indexsig", "mapped"], "{": [*_JS_ROLES["{"], "tlit", "enumbody", "moditems"], lexing.SUB_OPEN: ["sub", "tsub"]}
JAVASCRIPT = _script(_PLAIN_STUBS, _JS_ROLES, "static accessor", "")
TYPESCRIPT = _script(_TYPES, _TS_ROLES, "static accessor public private protected readonly abstract override declare", "public private protected readonly override")


# --- Go -----------------------------------------------------------------------

_GO = r"""
file = 'package' ID ';' ('import' (importspec | $imports) ';')* (topdecl ';')*
importspec = ('.' | ID)? STR
imports = (importspec (';' | &END))*
topdecl = decl | 'func' $params? ID $tparams? $params result? $block?
decl = 'const' (constspec | $consts) | 'var' (varspec | $vars) | 'type' (typespec | $typespecs)
consts = (constspec (';' | &END))*
vars = (varspec (';' | &END))*
typespecs = (typespec (';' | &END))*
ids = ID (',' ID)*
constspec = ids (type? '=' exprs)?
varspec = ids (type ('=' exprs)? | '=' exprs)
typespec = ID ($tparams type | '='? type)
result = $params | type
type = ID ('.' ID)? $targs? | '*' type | $arr type | 'map' $onetype type | 'chan' '<-'? type | '<-' 'chan' type | 'func' $params result? | 'struct' $fields | 'interface' $ifc | $ptype
ptype = type
onetype = type
targs = type (',' type)* ','?
tparams = ID union? (',' ID union?)* ','?
union = '~'? type ('|' '~'? type)*
arr = ('...' | expr)?
params = (param (',' param)* ','?)?
param = ID '...'? type | '...'? type
fields = (field (';' | &END))*
field = '*'? ID ('.' ID)? $targs? STR? &(';' | END) | ids type STR?
ifc = ((ID $params result? | union) (';' | &END))*
block = (stmt? ';')* stmt?
stmt = decl | ID ':' ';'* stmt? | 'return' exprs? | ('break' | 'continue') ID? | 'goto' ID | 'fallthrough' | ('go' | 'defer') expr | $block | ifstmt
  | 'for' ((exprsN (':=' | '='))? 'range' exprN | simpleN? ';' exprN? ';' simpleN? | exprN)? $block | 'switch' (simpleN? ';')? simpleN? $cases | 'select' $cases | simple
ifstmt = ifhead ('else' ifhead)* ('else' $block)?
ifhead = 'if' (simpleN? ';')? exprN $block
cases = (('case' simple | 'default') ':' (stmt? ';')* (stmt &END)?)*
simple@ = ids ':=' exprs@ | exprs@ (('=' | OPASSIGN) exprs@ | '++' | '--' | '<-' expr@)?
exprs@ = expr@ (',' expr@)*
expr@ = unary@ (BINOP unary@)*
unary@ = ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* primary@ post*
primary@ = NUM | STR | {LIT} ID | $pexpr | 'func' $params result? $block? | typelit $lit?
typelit = $arr type | 'map' $onetype type | 'chan' '<-'? type | 'struct' $fields | 'interface' $ifc
post = '.' (ID | $typesw | $ptype) | $args | $ix
typesw = 'type'
args = (expr '...'? (',' expr '...'?)* ','?)?
pexpr = expr
ix = expr? ':' (expr (':' expr)?)? | expr (',' expr)* ','?  (':' expr? (':' expr)?)?
lit = (entry (',' entry)* ','?)?
entry = value (':' value)?
value = expr | $lit
"""
_G = lexing.GO
_GO_ENDS = "ins-" + "".join(_G[w] for w in "break continue fallthrough return ++ --".split())
_GO_LINES = re.compile(rf"(?<=[{_GO_ENDS}])\n")
GO = Grammar(
    {"(": ["args", "params", "imports", "consts", "vars", "typespecs", "ptype", "pexpr", "typesw"], "[": ["arr", "ix", "targs", "onetype", "tparams"], "{": ["block", "fields", "ifc", "lit", "cases"]},
    _vary(_GO, {"": {"LIT": "ID ('.' ID)? $targs? $lit |"}, "N": {"LIT": ""}}),
    _G,
    {"ID": "i", "NUM": "n", "STR": "s", "OPASSIGN": _G["op="], "BINOP": "+-*/%&|^<>" + "".join(_G[x] for x in "&& || == != <= >= << >> &^".split())},
    "file",
    lambda s, bracket: _GO_LINES.sub(";", s if bracket else s + "\n").replace("\n", ""),
)

GRAMMARS: dict[str, Grammar] = {"rust": RUST, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO}
