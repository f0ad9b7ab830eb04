"""Grammars of the languages, as text, and table-driven LL(1) parsers built from them.

A grammar is lines `name: alternatives`; quoted words are tokens as written, upper-case names are token classes, lower-case
names are rules, and ( ) | * + ? have their usual meaning. Where two alternatives begin alike the first one wins. `@brace` is
decided by the token before an opening brace: after the end of a function's head it is `body`, else `braced_init`.
The grammars accept the languages' files and a little more; operators have no precedence, for that decides no validity.
"""

from __future__ import annotations

import re

END = "END"

JSON = """
start: value
value: '{' pairs? '}' | '[' values? ']' | STR | NUM | 'true' | 'false' | 'null'
pairs: pair (',' pair)*
pair: STR ':' value
values: value (',' value)*
"""

PYTHON = """
start: (NEWLINE | stmt)*
stmt: simple | compound
simple: small (';' small?)* NEWLINE
small: 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)? | 'del' exprs | 'global' names | 'nonlocal' names
     | 'assert' test (',' test)? | import | from | TYPE NAME typeparams? '=' test | exprs assigned
assigned: ':' test ('=' (yield | exprs))? | AUGMENT (yield | exprs) | ('=' (yield | exprs))*
names: NAME (',' NAME)*
import: 'import' dotted_as (',' dotted_as)*
dotted_as: dotted ('as' NAME)?
dotted: NAME ('.' NAME)*
from: 'from' ('.' | '...')* dotted? 'import' ('*' | '(' import_as (',' import_as?)* ')' | import_as (',' import_as)*)
import_as: NAME ('as' NAME)?
compound: if | while | for | try | with | decorated | def | class | async | match
if: 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
while: 'while' named ':' suite ('else' ':' suite)?
for: 'for' targets 'in' exprs ':' suite ('else' ':' suite)?
try: 'try' ':' suite ('finally' ':' suite | except+ ('else' ':' suite)? ('finally' ':' suite)?)
except: 'except' '*'? (test ('as' NAME)?)? ':' suite
with: 'with' with_item (',' with_item)* ':' suite
with_item: test ('as' target)?
decorated: ('@' named NEWLINE)+ (def | class | 'async' def)
async: 'async' (def | with | for)
def: 'def' NAME typeparams? '(' params? ')' ('->' exprs)? ':' suite
class: 'class' NAME typeparams? ('(' args? ')')? ':' suite
typeparams: '[' typeparam (',' typeparam?)* ']'
typeparam: ('*' | '**')? NAME (':' test)? ('=' test)?
params: param (',' param?)*
param: NAME (':' test)? ('=' test)? | '*' (NAME (':' star_test)?)? | '**' NAME (':' test)? | '/'
star_test: '*' test | test
match: MATCH exprs ':' NEWLINE INDENT case+ DEDENT
case: CASE patterns ('if' named)? ':' suite
patterns: pattern (',' pattern?)*
pattern: ('*' NAME | or_pattern) ('as' NAME)?
or_pattern: closed ('|' closed)*
closed: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | NAME ('.' NAME)* ('(' pattern_args? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (key_pattern (',' key_pattern?)*)? '}'
pattern_args: pattern ('=' pattern)? (',' (pattern ('=' pattern)?)?)*
key_pattern: '**' NAME | or_pattern ':' pattern
suite: simple | NEWLINE INDENT stmt+ DEDENT
yield: 'yield' ('from' test | exprs?)
exprs: element (',' element?)*
element: '*' arith | named
targets: target (',' target?)*
target: '*'? arith_noin
named: test (':=' test)?
test: 'lambda' lambda_params? ':' test | 'yield' ('from' test | exprs?) | logic ('if' logic 'else' test)?
lambda_params: lambda_param (',' lambda_param?)*
lambda_param: NAME ('=' test)? | '*' NAME? | '**' NAME | '/'
logic: operand (operator operand)*
operand: ('not' | '-' | '+' | '~' | 'await')* atom trailer*
operator: 'or' | 'and' | 'not' 'in' | 'in' | 'is' 'not'? | COMPARE | '<' | '>' | '*' | '**' | '-' | '+' | '|' | '/' | '@' | OPERATOR
arith: operand_only
operand_only: logic
arith_noin: ('-' | '+' | '~' | 'await')* atom trailer*
atom: NAME | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' group? ')' | '[' group? ']' | '{' (dict_item comp* (',' dict_item?)*)? '}'
group: element ('as' target)? comp* (',' (element ('as' target)?)?)*
dict_item: '**' test | '*' arith | named (':' test)?
comp: 'async'? 'for' targets 'in' logic ('if' cond)*
cond: 'lambda' lambda_params? ':' cond | logic (':=' logic)?
trailer: '(' args? ')' | '[' subscripts ']' | '.' NAME
args: arg (',' arg?)*
arg: '*' test | '**' test | test (':=' test | '=' test)? comp*
subscripts: subscript (',' subscript?)*
subscript: ':' test? (':' test?)? | '*' test | named (':' test? (':' test?)?)?
"""

JAVA = """
start: package? (import | type_decl | ';' | module)*
package: 'package' qname ';'
module: 'module' qname '{' directive* '}'
directive: NAME (NAME | '.' | ',' | 'static')* ';'
import: 'import' 'static'? NAME ('.' (NAME | '*'))* ';'
qname: NAME ('.' NAME)*
modifier: MODIFIER | 'static' | 'default' | 'synchronized' | annotation
annotation: '@' qname ('(' annotation_args? ')')?
annotation_args: annotation_value (',' annotation_value?)*
annotation_value: '{' annotation_args? '}' | annotation | expr
type_decl: modifier* type_kind
type_kind: 'class' NAME type_params? ('extends' type)? ('implements' types)? ('permits' types)? class_body
  | 'interface' NAME type_params? ('extends' types)? ('permits' types)? class_body | '@interface' NAME class_body
  | 'enum' NAME ('implements' types)? '{' constants? (';' member*)? '}' | 'record' NAME type_params? '(' params? ')' ('implements' types)? class_body
constants: constant (',' constant?)*
constant: annotation* NAME ('(' args? ')')? class_body?
types: type (',' type)*
class_body: '{' member* '}'
member: ';' | '{' stmt* '}' | modifier+ member_rest | member_rest
member_rest: '{' stmt* '}' | type_kind | type_params? ('void' NAME method | type after_type)
after_type: '(' params? ')' throws? '{' stmt* '}' | '{' stmt* '}' | NAME (method | fields ';')
method: '(' params? ')' dims throws? ('{' stmt* '}' | ';' | 'default' annotation_value ';')
throws: 'throws' types
fields: dims ('=' init)? (',' NAME dims ('=' init)?)*
init: '{' (init (',' init?)*)? '}' | expr
params: param (',' param)*
param: modifier* type '...'? ('this' | NAME) dims
type: annotation* (PRIMITIVE | class_type) dims
class_type: NAME type_args? ('.' NAME type_args?)*
dims: ('[' ']')*
type_params: '<' type_param (',' type_param)* '>'
type_param: annotation* NAME ('extends' type ('&' type)*)?
type_args: '<' (type_arg (',' type_arg)*)? '>'
type_arg: '?' (('extends' | 'super') type)? | type
block: '{' stmt* '}'
stmt: block | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' for_control ')' stmt | switch | 'return' expr? ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'throw' expr ';'
  | 'try' ('(' resource (';' resource?)* ')' block catch* ('finally' block)? | block (catch+ ('finally' block)? | 'finally' block)) | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';'
  | (MODIFIER | annotation | 'static')+ (type_kind | type NAME fields ';') | type_kind | local ';' | NAME named_stmt | expr_start ';'
named_stmt: ':' stmt | named_rest ';'
local: PRIMITIVE (dims NAME fields | '.' 'class' tail* operations)
named_rest: NAME fields | '<' (type_arg (',' type_arg)*)? '>' ('.' NAME type_args?)* (dims NAME fields | '::' (NAME | 'new'))
  | '.' (NAME named_rest | type_args NAME tail* operations | ('class' | 'this' | 'super' | 'new' creation) tail* operations)
  | '[' (']' dims (NAME fields | '::' 'new') | expr ']' tail* operations) | calls operations
calls: ('(' args? ')' tail* | '++' tail* | '--' tail* | '::' (NAME | 'new') tail*)?
resource: modifier* NAME (named_rest) | PRIMITIVE NAME fields
catch: 'catch' '(' modifier* class_type (BINARY class_type)* NAME ')' block
for_control: ';' expr? ';' exprs? | modifier+ type NAME for_decl | PRIMITIVE dims NAME for_decl | NAME named_rest for_more | expr_start for_more
for_decl: ':' expr | fields ';' expr? ';' exprs?
for_more: ':' expr | (',' expr)* ';' expr? ';' exprs?
exprs: expr (',' expr)*
switch: 'switch' '(' expr ')' '{' switch_item* '}'
switch_item: 'case' case_label (',' case_label)* (':' | '->' value?) | 'default' (':' | '->' value?) | stmt
value: (NUM | CHAR | 'true' | 'false' | 'null') tail* operations ';'
case_label: 'default' | operand NAME? (NAME operand guard*)?
guard: BINARY operand | '*' operand | '+' operand | '-' operand | '<' operand | '>' operand | '&' operand | 'instanceof' 'final'? operand NAME?
expr: operand operations
expr_start: PREFIX operand operations | '(' paren ')' after_paren tail* operations | '+' operand operations | '-' operand operations | '++' operand operations | '--' operand operations | start_primary tail* operations
start_primary: STR | 'this' | 'super' | PRIMITIVE | 'void' | 'new' creation | switch
operations: operation*
operation: BINARY operand | '*' operand | '+' operand | '-' operand | '<' operand? | '>' ('>' '>'?)? operand? | '&' operand? | '=' init | '?' expr ':' operand | 'instanceof' 'final'? operand NAME? | '->' (block | operand)
operand: ('+' | '-' | PREFIX | '++' | '--')* primary tail*
primary: NAME | strict_primary | '(' paren ')' after_paren
strict_primary: NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | PRIMITIVE | 'void' | 'new' creation | switch
paren: (paren_item (',' paren_item)*)?
paren_item: modifier+ type '...'? NAME | '[' ']' | expr (NAME | '...' NAME)?
after_paren: (NAME | NUM | STR | CHAR | 'new' creation | 'this' | 'super' | 'true' | 'false' | 'null' | PREFIX operand | switch)?
tail: '.' (NAME | type_args NAME | 'class' | 'this' | 'super' | 'new' creation) | '(' args? ')' | '[' (expr)? ']' | '++' | '--' | '::' (NAME | 'new')
args: expr (',' expr)*
creation: annotation* (PRIMITIVE | class_type) ('(' args? ')' class_body? | ('[' expr? ']')+ braces?)
braces: '{' (init (',' init?)*)? '}'
"""

_C_SHARED = """
ptr: ('*' | '&' | '&&') qualifier*
qualifier: QUALIFIER | attribute
attribute: ATTRIBUTE '(' ignored* ')'
ignored: '(' ignored* ')' | NAME | STR | NUM | ',' | TYPE | QUALIFIER | CHAR
direct: word_name | '(' ptr* direct ')'
suffix: '[' exprs? ']' | '(' params? ')' | attribute
params: param (',' param?)*
param: '...' | word+ (ptr | '...')* (direct | '(' ptr+ direct? suffix* ')')? param_suffix* ('=' init)? | ptr+ direct? suffix* | NUM | STR | CHAR | '-' expr | '!' expr
param_suffix: suffix | '.' NAME | BINARY param_operand | '-' param_operand | '+' param_operand | '->' NAME
param_operand: ('-' | '*' | '&' | '!')* (NAME | NUM | STR | CHAR) suffix*
braced_init: '{' inits? '}' more_declarators ';'
inits: init_item (',' init_item?)*
init_item: ('.' NAME | '[' expr ('...' expr)? ']')+ ('=' init | braces) | init
init: braces | expr
braces: '{' inits? '}'
more_declarators: (',' ptr* direct suffix* (':' expr)? ('=' init | braces)?)*
block: '{' stmt* '}'
stmt: block | ';' | 'if' 'constexpr'? '(' cond ')' stmt ('else' stmt)? | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' for_control ')' stmt | 'switch' '(' cond ')' stmt | 'case' expr ('...' expr)? ':' | 'default' ':' | 'return' (braces | expr)? ';' | 'break' ';' | 'continue' ';' | 'goto' NAME ';'
  | extra_stmt | local_decl | NAME named_stmt | expr_start ';'
named_stmt: ':' | named_rest ';'
local_decl: typed_word word_tail* local_rest ';'
local_rest: declared? more_declarators
declared: ptr+ direct suffix* local_init? | suffix+ local_init? | local_init
local_init: '=' init | braces
named_rest: word_name_strict word_tail* local_rest | calls operations (',' expr)*
exprs: expr (',' expr)*
for_control: ';' exprs? ';' exprs? | typed_word word_tail* local_rest for_more | NAME named_rest for_more | expr_start for_more
for_more: ':' (braces | expr) | ';' exprs? ';' exprs?
expr: operand operations
expr_start: (PREFIX | '~') operand operations (',' expr)* | '(' paren ')' after_paren tail* operations (',' expr)* | ('+' | '-' | '*' | '&' | '++' | '--') operand operations (',' expr)* | strict_primary tail* operations (',' expr)*
operations: operation*
operation: BINARY operand | '+' operand | '-' operand | '*' operand? | '&' operand? | '&&' operand | '<' operand? | '>' ('>')? operand? | '=' init | '?' exprs? ':' operand
operand: ('+' | '-' | '*' | '&' | '&&' | PREFIX | '~' | '++' | '--')* primary tail*
primary: NAME | strict_primary | '(' paren ')' after_paren
"""

C = (
    """
start: external*
external: ';' | 'extern' extern_rest | '_Static_assert' '(' exprs ')' ';' | declaration
extern_rest: STR ('{' external* '}' | declaration) | word* declaration_rest
declaration: word+ declaration_rest
declaration_rest: first_declarator? declaration_end
first_declarator: ptr+ direct suffix* | suffix+
declaration_end: ';' | '=' init more_declarators ';' | ',' ptr* direct suffix* (':' expr)? ('=' init)? more_declarators ';' | ':' expr more_declarators ';' | @brace
body: block
word: TYPE | QUALIFIER | NAME | struct | enum | attribute | 'typedef' | 'typeof' '(' word+ ptr* ')'
word_tail: word
word_name: NAME
word_name_strict: NAME | QUALIFIER | TYPE
typed_word: TYPE | QUALIFIER | struct | enum | 'typedef' | 'extern' | 'typeof' '(' word+ ptr* ')'
struct: ('struct' | 'union') attribute* (NAME attribute* members? | members)
members: '{' (declaration | ';')* '}'
enum: 'enum' NAME? ('{' (constant (',' constant?)*)? '}')?
constant: NAME attribute* ('=' expr)?
extra_stmt: ASM ignored_stmt ';'
ignored_stmt: QUALIFIER* 'goto'? '(' (expr | ':' | ',' | '[' expr ']')* ')'
cond: exprs
calls: tail*
strict_primary: NUM | STR+ | CHAR | 'sizeof' size | TYPE ptr* | QUALIFIER word+ ptr* | struct ptr* | enum ptr*
size: '(' paren ')' tail* | operand
paren: exprs | block
after_paren: (NAME | NUM | STR | CHAR | braces | (PREFIX | '~') operand | 'sizeof' size)?
tail: '.' NAME | '->' NAME | '(' args? ')' | '[' expr ']' | '++' | '--'
args: arg (',' arg)*
arg: expr word*
"""
    + _C_SHARED
)

CPP = (
    """
start: external*
external: ';' | 'extern' extern_rest | 'namespace' namespace | 'inline' ('namespace' namespace | declaration) | 'using' using ';' | 'static_assert' '(' exprs ')' ';' | template | '[' '[' attr* ']' ']' | declaration
attr: NAME | '::' | '(' ignored* ')' | ','
namespace: (NAME ('::' NAME)*)? ('{' external* '}' | '=' NAME ('::' NAME)* ';')
using: 'namespace' '::'? NAME ('::' NAME)* | ('typename' | 'enum')? '::'? NAME targs? ('::' (NAME targs? | 'operator' operator))* ('=' type)? '...'? (',' NAME targs? ('::' NAME targs?)* '...'?)*
template: 'template' ('<' tparams? '>' requires? (external) | declaration)
requires: 'requires' operand operations
tparams: tparam (',' tparam)*
tparam: ('typename' | 'class') '...'? NAME? ('=' type)? | 'template' '<' tparams? '>' ('class' | 'typename') NAME? ('=' type)? | word+ ptr* NAME? ('=' operand)?
type: word+ (ptr | '[' ']' | '(' params? ')' | '(' ptr+ ')')*
targs: '<' (targ (',' targ)*)? '>'
targ: (NUM | CHAR | 'true' | 'false' | STR | '-' NUM) | type '...'?
extern_rest: STR ('{' external* '}' | declaration) | template | word* declaration_rest
declaration: word+ declaration_rest
declaration_rest: first_declarator? declaration_end
first_declarator: ptr+ direct suffix* trailer* | suffix+ trailer*
trailer: QUALIFIER ('(' expr ')')? | 'override' | 'final' | 'noexcept' ('(' expr ')')? | 'throw' '(' ignored* ')' | '&' | '&&' | '->' type | attribute | '[' expr? ']' | '(' params? ')' | requires | 'try'
declaration_end: ';' | '=' ('default' | 'delete' | init) more_declarators ';' | ',' ptr* direct suffix* (':' expr)? ('=' init)? more_declarators ';' | ':' colon | @brace
colon: NUM ('=' init)? more_declarators ';' | ctor_init (',' ctor_init)* (';' | body)
ctor_init: NAME targs? ('::' NAME targs?)* ('(' args? ')' | braces)? '...'?
body: block catch*
catch: 'catch' '(' (param) ')' block
word: TYPE | QUALIFIER | name | struct | enum | attribute | 'typedef' | 'friend' | 'inline' | 'constexpr' | 'mutable' | 'auto' | 'decltype' '(' expr ')' | 'typename' | 'operator' operator | '~' NAME | '::'
name: NAME targs? ('::' ('~' NAME | 'template'? NAME targs? | 'operator' operator | '*'))*
operator: '(' ')' | '[' ']' | BINARY | PREFIX | '~' | '+' | '-' | '*' | '&' | '&&' | '<' | '>' '>'? | '=' | '++' | '--' | '->' | ',' | 'new' ('[' ']')? | 'delete' ('[' ']')? | TYPE | NAME targs? ('::' NAME targs?)* ptr* | STR NAME | 'bool'
word_tail: word
word_name: name | '~' NAME | 'operator' operator | '[' NAME (',' NAME)* ']'
word_name_strict: NAME | QUALIFIER | TYPE
typed_word: TYPE | QUALIFIER | struct | enum | 'typedef' | 'extern' | 'auto' | 'decltype' '(' expr ')' | 'typename' | 'inline' | 'constexpr'
struct: ('struct' | 'union' | 'class') attribute* (name ('final')? (':' bases)? members? | members)
bases: base (',' base)*
base: (ACCESS | 'virtual')* name '...'?
members: '{' member* '}'
member: ACCESS ':' | ';' | 'using' using ';' | 'static_assert' '(' exprs ')' ';' | 'template' '<' tparams? '>' requires? member | 'virtual' declaration | 'explicit' ('(' expr ')')? declaration | declaration
enum: 'enum' ('class' | 'struct')? NAME? (':' word+)? ('{' (constant (',' constant?)*)? '}')?
constant: NAME ('=' expr)?
extra_stmt: 'try' block catch+ | 'throw' expr? ';' | 'using' using ';' | 'static_assert' '(' exprs ')' ';' | ASM QUALIFIER* 'goto'? '(' ('::' | ':' | expr | ',' | '[' expr ']')* ')' ';' | 'delete' ('[' ']')? expr ';' | 'namespace' NAME '=' name ';'
cond: typed_word word_tail* local_rest (';' exprs)? | exprs (NAME '=' init)? (';' exprs)?
named_rest: '::' ('template'? NAME named_rest | '~' NAME calls operations | 'operator' operator calls operations)
calls: tail*
strict_primary: NUM | STR+ | CHAR | 'true' | 'false' | 'nullptr' | 'this' | 'sizeof' size | TYPE ptr* | 'auto' | QUALIFIER word+ ptr* | struct | enum | CAST targs '(' expr ')' | 'new' creation | lambda | '::' NAME NAME? | 'throw' expr | 'delete' ('[' ']')? operand | 'typename' name | 'operator' operator | 'co_await' operand | 'decltype' '(' expr ')' | 'noexcept' '(' expr ')' | 'requires' ('(' params? ')')? '{' requirement* '}'
requirement: 'typename' name ';' | '{' expr '}' 'noexcept'? ('->' type)? ';' | expr ';'
size: '...'? '(' paren ')' tail* | operand
creation: ('(' args? ')')? word+ ptr* ('[' expr ']')* ('(' args? ')' | braces)?
lambda: '[' (capture (',' capture)*)? ']' ('<' tparams '>')? ('(' params? ')')? ('mutable' | QUALIFIER | 'noexcept' | '->' type)* block
capture: ('&' | '=' | '*')* ('this' | NAME '...'?)? ('=' expr)?
paren: (exprs '...'? | '...' BINARY expr)?
after_paren: (NAME | NUM | STR | CHAR | 'this' | (PREFIX | '~') operand | 'new' creation | 'sizeof' size | CAST targs '(' expr ')' | 'nullptr' | 'true' | 'false')?
tail: '.' ('template'? NAME | '~' NAME | '*' NAME) | '->' ('template'? NAME | '~' NAME | '*' NAME) | '(' args? ')' | '[' expr ']' | '++' | '--' | '::' (NAME | '~' NAME | 'template' NAME | 'operator' operator) | braces
args: arg (',' arg)*
arg: braces | expr '...'? word*
"""
    + _C_SHARED
)

_PART = re.compile(r"'([^']+)'|([A-Za-z_@]+)|([()|*+?])")


def rules_of(text: str) -> dict[str, list[list[str]]]:
    """Plain alternatives of each rule; groups and repetitions become rules of their own. Tokens are marked by a leading ':'."""
    out: dict[str, list[list[str]]] = {}
    entries: list[list[str]] = []
    for line in text.splitlines():
        if m := re.match(r"(\w+): (.*)", line):
            entries.append([m.group(1), m.group(2)])
        elif line.strip():
            entries[-1][1] += " " + line.strip()

    def new(owner: str, alternatives: list[list[str]]) -> str:
        name = f"{owner}.{len(out)}"
        out[name] = alternatives
        return name

    def alternatives(owner: str, parts: list[tuple[str, str, str]], at: int) -> tuple[list[list[str]], int]:
        found: list[list[str]] = [[]]
        while at < len(parts):
            token, name, sign = parts[at]
            if sign == ")":
                break
            if sign == "|":
                found.append([])
                at += 1
                continue
            if sign == "(":
                inner, at = alternatives(owner, parts, at + 1)
                symbol = new(owner, inner)
            else:
                symbol = ":" + (token or name) if token or name.isupper() else name
            at += 1
            if at < len(parts) and parts[at][2] in ("*", "+", "?"):
                sign = parts[at][2]
                at += 1
                if sign == "?":
                    symbol = new(owner, [[symbol], []])
                else:
                    again = f"{owner}.{len(out)}"
                    out[again] = [[symbol, again], []]
                    symbol = again if sign == "*" else new(owner, [[symbol, again]])
            found[-1].append(symbol)
        return found, at

    for name, body in entries:
        out.setdefault(name, []).extend(alternatives(name, _PART.findall(body), 0)[0])
    return out


class Parser:
    """The LL(1) table of a grammar and its driver."""

    def __init__(self, text: str, heads: frozenset[str] = frozenset()):
        rules = rules_of(text)
        rules["@brace"] = rules.get("@brace", [])
        self.heads = heads
        first: dict[str, set[str]] = {n: set() for n in rules}
        empty: set[str] = set()
        follow: dict[str, set[str]] = {n: set() for n in rules}
        follow["start"].add(END)
        first["@brace"] = {"{"}

        def first_of(symbols: list[str]) -> tuple[set[str], bool]:
            out: set[str] = set()
            for s in symbols:
                if s[0] == ":":
                    return out | {s[1:]}, False
                out |= first[s]
                if s not in empty:
                    return out, False
            return out, True

        changed = True
        while changed:
            changed = False
            for n, alternatives in rules.items():
                for a in alternatives:
                    f, e = first_of(a)
                    if not f <= first[n] or e and n not in empty:
                        first[n] |= f
                        changed = True
                        if e:
                            empty.add(n)
        changed = True
        while changed:
            changed = False
            for n, alternatives in rules.items():
                for a in alternatives:
                    for k, s in enumerate(a):
                        if s[0] != ":":
                            f, e = first_of(a[k + 1 :])
                            f = f | follow[n] if e else f
                            if not f <= follow[s]:
                                follow[s] |= f
                                changed = True
        number = {n: k for k, n in enumerate(rules)}
        code = lambda s: s[1:] if s[0] == ":" else number[s]
        self.table: list[dict[str, tuple]] = [{} for _ in rules]
        for n, alternatives in rules.items():
            for a in alternatives:
                f, e = first_of(a)
                body = tuple(code(s) for s in reversed(a))
                for t in f:
                    self.table[number[n]].setdefault(t, body)
            for a in alternatives:
                f, e = first_of(a)
                if e:
                    body = tuple(code(s) for s in reversed(a))
                    for t in follow[n]:
                        self.table[number[n]].setdefault(t, body)
        self.start, self.brace = number["start"], number["@brace"]
        self.after_head = (number["body"],) if "body" in number else ()
        self.after_name = (number["braced_init"],) if "braced_init" in number else ()

    def error(self, kinds: list[str]) -> int | None:
        """Place of the first token of a file that no derivation admits; None if the whole file is derived. kinds ends with END."""
        stack: list = [END, self.start]
        pop, push, table, brace = stack.pop, stack.extend, self.table, self.brace
        for at, kind in enumerate(kinds):
            while True:
                top = pop()
                if top.__class__ is str:
                    if top == kind:
                        break
                    return at
                if top == brace:
                    if kind != "{":
                        return at
                    push(self.after_head if kinds[at - 1] in self.heads else self.after_name)
                    continue
                body = table[top].get(kind)
                if body is None:
                    return at
                if body:
                    push(body)
        return None
