"""Token tables and parsing-expression grammars of the supported languages."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from graphlake.llm.packrat import Grammar

# Kinds that all languages share: a name, a number, a string, a bad character, a conflict marker, a line end.
ID, NUM, STR, BAD, CONFLICT, LINE, INDENT, DEDENT = "a", "0", "s", "X", "M", "N", "I", "D"

# Marks of two kinds in one token, and of line ends that count; neither is a kind itself.
_PAIR, _KEPT = "\ue000", "\x01"

_CONFLICT = r"(?m:^(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|^={7}$)"
_NAME = r"[^\W\d]\w*"


class Kinds(dict):
    """Token text to its kind; what is not in the table is told by its first characters."""

    def __init__(self, table: dict[str, str], tell: Callable[[str], str]):
        super().__init__(table)
        self.tell = tell

    def __missing__(self, token: str) -> str:
        kind = self.tell(token)
        if len(token) <= 24 and len(self) < 200_000:
            self[token] = kind
        return kind


@dataclass
class Language:
    name: str
    lexer: re.Pattern
    quick: re.Pattern  # finds the same tokens, but for most of those that have no kind
    kinds: Kinds
    grammar: Grammar
    arrange: Callable[[list[str], list[str]], tuple[str, object]]

    def read(self, text: str) -> tuple[str, list[str], object]:
        """(kind string, token texts, and what tells the token of a kind)."""
        return self._arranged(self.lexer.findall(text))

    def read_quick(self, text: str) -> tuple[str, list[str], object]:
        """The same kind string as `read`, without all tokens that have no kind.

        No line end is left out of Python, JavaScript and TypeScript.
        """
        return self._arranged(self.quick.findall(text))

    def _arranged(self, tokens: list[str]) -> tuple[str, list[str], object]:
        kinds = list(map(self.kinds.__getitem__, tokens))
        string, where = self.arrange(tokens, kinds)
        return string, tokens, where


class _Lazy:
    """For each kind that was kept, the index of its token; worked out only when a failure is reported."""

    def __init__(self, kinds: list[str], keep: re.Pattern | None = None):
        self.kinds, self.keep = kinds, keep

    def after(self, string: str, at: int) -> int:
        flat = [k for k, v in enumerate(self.kinds) for _ in v]
        kept = flat
        if self.keep is not None:
            marked = self.keep.sub(lambda m: _KEPT + LINE * (len(m.group()) - 1), "".join(self.kinds))
            kept = [k for k, c in zip(flat, marked, strict=True) if c != LINE]
        return kept[at] if at < len(kept) else len(self.kinds)


def _plain(tokens: list[str], kinds: list[str]) -> tuple[str, _Lazy]:
    return "".join(kinds), _Lazy(kinds)


def _table(words: str, soft: str, signs: str) -> tuple[dict[str, str], str]:
    """Kinds of keywords, of words that are also names, and of signs; and the class of all names."""
    table: dict[str, str] = {}
    names = ID
    at = 0x80  # up to 0xff a kind is one byte
    for w in words.split():
        table[w] = chr(at)
        at += 1
    for w in soft.split():
        table[w] = chr(at)
        names += chr(at)
        at += 1
    for sign in signs.split():
        if len(sign) == 1:
            table[sign] = sign
        else:
            table[sign] = chr(at)
            at += 1
    return table, names


def _tell(comments: tuple[str, ...], quotes: str, extra: Callable[[str], str | None] = lambda t: None) -> Callable[[str], str]:
    def tell(token: str) -> str:
        special = extra(token)
        if special is not None:
            return special
        first = token[0]
        if first.isspace() or token.startswith(comments):
            return ""
        if first in "<=>|" and len(token) >= 7 and token[:7] == first * 7:
            return CONFLICT
        if len(token) > 1 and (first in quotes or token[-1] in quotes):
            return STR
        if first.isalpha() or first in "_$":
            return ID
        if first.isdigit() or (first == "." and len(token) > 1 and token[1].isdigit()):
            return NUM
        return BAD

    return tell


def _quick(lexer: str, early: str, skipped: str) -> re.Pattern:
    """Tokens together with the blanks and comments after them; `early` finds frequent tokens as `lexer` would."""
    return re.compile(rf"({early}|{lexer})(?:{skipped})*+")


def _build(name: str, lexer: str, early: str, skipped: str, words: str, soft: str, signs: str, grammar: str, comments: tuple[str, ...], quotes: str, extra=lambda t: None, arrange=_plain, drop: str = "") -> Language:
    table, names = _table(words, soft, signs)
    classes = {"ID": names, "NUM": NUM, "STR": STR, "NL": LINE, "INDENT": INDENT, "DEDENT": DEDENT}
    kinds = dict(table)
    return Language(name, re.compile(lexer), _quick(lexer, early, skipped), Kinds(table, _tell(comments, quotes, extra)), Grammar(grammar, kinds, classes), arrange(table) if arrange is not _plain else _plain)


_SIGNS_C = "( ) [ ] { } , ; : . ? @ # ~ ! + - * / % & | ^ = < >"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eEpP][+-]?\d[\d_]*)?)[a-zA-Z0-9_]*"
_DQ = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_SLASH = r"//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
# Signs that begin no longer token, and points before a name.
_SINGLE, _POINT = r"[()\[\]{},;]", r"\.(?=[A-Za-z_$])"


# JavaScript and TypeScript ------------------------------------------------------------------------------------

def _template(depth: int) -> str:
    if depth == 0:
        return r"`(?:[^`\\]|\\[\s\S])*`"
    inner = rf"(?:[^`{{}}'\"]|{_DQ}|{_SQ}|{_template(depth - 1)}|\{{(?:[^`{{}}'\"]|{_DQ}|{_SQ}|\{{[^{{}}`]*\}})*\}})*"
    return rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{inner}\}})*`"


_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*"
_JS_LEX = (
    # Names first, the most frequent tokens, but for the words that a regular expression can follow.
    rf"\s+|(?!(?:return|typeof|case)\b)[#]?(?:[^\W\d]|\$)[\w$]*|{_SLASH}|{_CONFLICT}|(?:=>|&&|\|\||\?\?|[=!]==?|[(,=:\[!&|?{{;+~^]|\breturn|\btypeof|\bcase)[ \t]*\n?[ \t]*{_REGEX}|{_DQ}|{_SQ}|{_template(3)}|[#]?(?:[^\W\d]|\$)[\w$]*|{_NUMBER}"
    r"|>>>=|>>=|<<=|\*\*=|&&=|\|\|=|\?\?=|===|!==|\.\.\.|\*\*|==|!=|<=|>=|=>|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|<<|[+\-*/%&|^]=|[\s\S]")
# A bracket or sign that a regular expression may follow is left to the lexer, and so are three words.
_JS_EARLY = rf"(?![rtc](?:eturn|ypeof|ase)\b)[A-Za-z_$][\w$]*|[)\]}}]|[(,;{{](?![ \t\n]*/)|{_POINT}"
_JS_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
_JS_SOFT = "async await of get set static from as let yield type interface declare namespace module abstract readonly public private protected implements keyof is infer satisfies override accessor asserts unique target"
_JS_SIGNS = _SIGNS_C + " >>>= >>= <<= **= &&= ||= ??= === !== ... ** == != <= >= => ++ -- && || ?? ?. << += -= *= /= %= &= |= ^="


_JS_PAIRED = re.compile(rf"(?s)(=>|&&|\|\||\?\?|[=!]==?|[(,=:\[!&|?{{;+~^]|return|typeof|case)\s*({_REGEX})")


def _js_extra(token: str) -> str | None:
    if token[0] in "\"'`":
        return None
    if token[0] == "\n" or (token[0].isspace() and "\n" in token):
        return LINE
    if token.startswith("/*") and "\n" in token:
        return LINE
    if len(token) > 1 and token[0] == "#" and (token[1].isalpha() or token[1] in "_$"):
        return ID
    if token.startswith(("//", "/*")):
        return ""
    m = _JS_PAIRED.fullmatch(token)
    if m:
        return _PAIR + m.group(1) + _PAIR
    return None


def _js_arrange(table: dict[str, str]):
    soft = "".join(v for k, v in table.items() if k in _JS_SOFT.split())
    words = "".join(table[k] for k in "this super null true false return break continue".split())
    ends = "[" + re.escape(ID + NUM + STR + ")]}" + soft + words + table["++"] + table["--"]) + "]"
    starters = [k for k in _JS_WORDS.split() if k not in ("else", "catch", "finally", "in", "instanceof", "extends", "while")]
    begins = "[" + re.escape(ID + NUM + STR + "@!~" + soft + "".join(table[k] for k in starters) + table["++"] + table["--"]) + "]"
    # `while` after a block may close a do statement: no line end is needed there.
    begins_while = re.escape(table["while"])
    keep = re.compile(rf"(?<={ends})N+(?=(?:{begins}|{begins_while}|\}}|$))")

    def arrange(tokens: list[str], kinds: list[str]) -> tuple[str, object]:
        # A sign together with the regular expression after it: two kinds.
        joined = "".join(kinds)
        if _PAIR in joined:
            kinds = [table[k[1:-1]] + STR if k[:1] == _PAIR else k for k in kinds]
            joined = "".join(kinds)
        return keep.sub(_KEPT, joined).replace(LINE, "").replace(_KEPT, LINE), _Lazy(kinds, keep)

    return arrange


# @ stands for the context: F inside functions, where return may stand, T outside.
_JS_STATEMENT = """
Block@ <- "{" Stmts@ "}"
Stmts@ <- (NL / Stmt@)*
Stmt@ <- FlatStmt / Block@ / ";" / VarStmt / If@ / For@ / While@ / Do@ / Try@ / Switch@ / NamedFunction / Class / ThrowStmt / Jump / Return@ / Labelled@ / TypeDecl / Debugger / ExprStmt
If@ <- "if" "(" Exprs ")" NL? Stmt@ (NL? "else" NL? Stmt@)?
For@ <- "for" "await"? "(" ForHead ")" NL? Stmt@
While@ <- "while" "(" Exprs ")" NL? Stmt@
Do@ <- "do" NL? Stmt@ NL? "while" "(" Exprs ")" ";"?
Try@ <- "try" Block@ NL? ("catch" ("(" Binding TypeAnn? ")")? Block@ (NL? "finally" Block@)? / "finally" Block@)
Switch@ <- "switch" "(" Exprs ")" "{" NL* (("case" Exprs ":" / "default" ":") Stmts@)* "}"
Labelled@ <- ID ":" NL? Stmt@
"""
_JS_COMMON = """
Debugger <- "debugger" Semi
Semi <- ";" / NL / &"}" / !.
VarStmt <- ("const" !"let" ConstDecl ("," ConstDecl)* / ("let" !("=" / "." / "(" / "let") / "var") VarDecl ("," VarDecl)*) Semi
ThrowStmt <- "throw" Exprs Semi
Jump <- ("break" / "continue") ID? Semi
ReturnF <- "return" FlatExpr ";" / "return" Exprs? Semi
FlatStmt <- (FlatLead "=")? FlatExpr ";"
FlatExpr <- (FlatCall2 / FlatCall / Simple) &(";")
FlatCall <- Simple FlatArgs
FlatCall2 <- Simple "(" (FlatArg2 ("," FlatArg2)*)? ")"
FlatArg2 <- FlatCall / Simple !("=>")
ReturnT <- "return" !.  "return"
ForHead <- ("const" / "let" / "var")? Binding ("of" / "in") Exprs / (("const" / "let" / "var") VarDecl ("," VarDecl)* / Exprs)? ";" Exprs? ";" Exprs?
ExprStmt <- !("{" / "function" / "class" / "async" "function") Exprs Semi
Binding <- ID / "[" (","* BindingDefault)? ("," BindingDefault?)* ("..." Binding)? "]" / "{" (BindingProp ("," BindingProp)* ","?)? "}"
BindingDefault <- "..."? Binding ("=" Expr)?
BindingProp <- "..." ID / PropName ":" Binding ("=" Expr)? / ID ("=" Expr)?
Function <- "async"? "function" "*"? ID? Signature FBody
NamedFunction <- "async"? "function" "*"? ID Signature FBody
FBody <- BlockF
Params <- "(" (Param ("," Param)* ","?)? ")"
Class <- Decorator* "abstract"? "class" (!"extends" !"implements" ID)? TypeParams? ("extends" Left TypeArgs?)? ("implements" Type ("," Type)*)? "{" (NL / ";" / Member)* "}"
Decorator <- "@" ID ("." ID)* Args? NL?
Member <- Decorator* ("static" BlockF / Modifier* (("get" / "set" / "async")? "*"? PropName "?"? Signature (FBody / Semi) / IndexSig Semi / PropName ("?" / "!")? TypeAnn? ("=" Expr)? Semi / "[" Expr "]" Signature FBody))
Modifier <- ("static" / "public" / "private" / "protected" / "readonly" / "abstract" / "override" / "declare" / "async" / "accessor") !("(" / "=" / ";" / ":" / NL / "?")
PropName <- ID / Word / STR / NUM / "[" Expr "]"
Word <- "break" / "case" / "catch" / "class" / "const" / "continue" / "default" / "delete" / "do" / "else" / "export" / "extends" / "finally" / "for" / "function" / "if" / "import" / "in" / "instanceof" / "new" / "return" / "super" / "switch" / "this" / "throw" / "try" / "typeof" / "var" / "void" / "while" / "with" / "null" / "true" / "false" / "enum" / "debugger"
Exprs <- Expr ("," Expr)*
Expr <- Simple &(")" / "," / ";" / NL / "]" / "}") / Arrow / "yield" "*"? Expr / Cond !AssignOp / !Fixed Left AssignOp Expr / "yield"
Fixed <- (NUM / STR / "null" / "true" / "false" / "this") AssignOp
AssignOp <- "=" / ">>>=" / ">>=" / "<<=" / "**=" / "&&=" / "||=" / "??=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / ">" ">" "="
Simple <- (ID / "this" / NUM / STR / "null" / "true" / "false") ("." (ID / Word))*
FlatArgs <- "(" (Simple ("," Simple)*)? ")"
Arrow <- "async"? (ID / ArrowParams) "=>" NL? (BlockF / Expr)
Cond <- Binary ("?" Expr ":" Expr)?
Binary <- Unary (BinOp Unary)* Cast*
BinOp <- "**" / "*" / "/" / "%" / "+" / "-" / "<<" / ">" ">" ">" / ">" ">" !"=" / "<=" / ">=" / "<" / ">" / "===" / "!==" / "==" / "!=" / "&&" / "||" / "??" / "&" / "|" / "^" / "instanceof" / "in"
Unary <- ("!" / "~" / "+" / "-" / "typeof" / "void" / "delete" / "await" !("=" / "." / ")" / "," / ";") / "++" / "--")* Left ("++" / "--")?
Left <- Atom Tail*
Tail <- ("." / "?.") (ID / Word) / FlatArgs / Args / "?." (Args / "[" Exprs "]") / "[" Exprs "]" / STR / Generic
Args <- "(" ("..."? Expr ("," "..."? Expr)* ","?)? ")"
Atom <- Function / Class / "new" New / "import" (Args / "." ID) / ID / NUM / STR / "this" / "null" / "true" / "false" / "super" / "(" Exprs ")" / Array / Object
New <- "." "target" / "new" New / (ID / "this" / "(" Exprs ")" / Class / Function) ("." (ID / Word) / "[" Exprs "]")* TypeArgs? Args?
Array <- "[" (","* "..."? Expr)? ("," ("..."? Expr)?)* "]"
Object <- "{" (Property ("," Property)* ","?)? "}"
Property <- "..." Expr / (("get" / "set") / "async"? "*"?) PropName Signature FBody / PropName ":" Expr / ID ("=" Expr)?
Import <- "import" (STR / (ID ("," ("*" "as" ID / NamedImports))? / "*" "as" ID / NamedImports) "from" STR) ("with" Object)? Semi
NamedImports <- "{" ("type"? ImportName ("as" ID)? ("," "type"? ImportName ("as" ID)?)* ","?)? "}"
ImportName <- ID / Word / STR
Export <- "export" ("default" (Function / Class / "abstract" Class / Expr Semi / TypeDecl) / "*" ("as" ImportName)? "from" STR Semi / NamedExports ("from" STR)? Semi / VarStmt / NamedFunction / Class / TypeDecl)
NamedExports <- "{" ("type"? ImportName ("as" ImportName)? ("," "type"? ImportName ("as" ImportName)?)* ","?)? "}"
"""
_JS_ONLY = """
FlatLead <- ("const" / "let") !"let" ID / "var"? ID
ConstDecl <- Binding "=" Expr
VarDecl <- ID ("=" Expr)? / Binding "=" Expr
Signature <- Params
Param <- "..."? Binding ("=" Expr)?
ArrowParams <- Params
TypeAnn <- "type" "type" "type" !.
TypeParams <- TypeAnn
TypeArgs <- TypeAnn
Type <- TypeAnn
IndexSig <- TypeAnn
Generic <- TypeAnn
Cast <- TypeAnn
TypeDecl <- TypeAnn
"""
_TS_ONLY = """
FlatLead <- ("const" / "let") !"let" ID (":" ID)? / "var" ID (":" ID)? / ID
ConstDecl <- ID "!"? TypeAnn? "=" Expr / Binding TypeAnn? "=" Expr
VarDecl <- ID "!"? TypeAnn? ("=" Expr)? / Binding TypeAnn? "=" Expr
Signature <- TypeParams? Params (":" ReturnType)?
ReturnType <- "asserts" ID ("is" Type)? / (ID / "this") "is" Type / Type
Param <- Decorator* Modifier* "..."? ("this" / Binding) "?"? TypeAnn? ("=" Expr)?
ArrowParams <- TypeParams? Params (":" ReturnType)?
TypeAnn <- ":" Type
TypeParams <- "<" TypeParam ("," TypeParam)* ","? ">"
TypeParam <- ("const" / "in")* ID ("extends" Type)? ("=" Type)?
TypeArgs <- "<" Type ("," Type)* ">"
Type <- FunType / Union ("extends" Union "?" Type ":" Type)?
FunType <- "abstract"? "new"? TypeParams? Params "=>" ReturnType
Union <- ("|" / "&")? TypePost (("|" / "&") TypePost)*
TypePost <- ("keyof" / "readonly" / "unique" / "infer") !("." / "," / ")" / ">" / "=") TypePost / TypeAtom ("[" Type? "]")*
TypeAtom <- "(" Type ")" / "typeof" Left TypeArgs? / "import" "(" STR ")" ("." ID)* TypeArgs? / (ID / "void" / "null" / "this" / "true" / "false") ("." ID)* TypeArgs? / STR / "-"? NUM / "[" (TupleItem ("," TupleItem)* ","?)? "]" / "{" TypeMembers "}"
TupleItem <- "..."? (ID "?"? ":" Type / Type "?"?)
TypeMembers <- (NL / ";" / "," / TypeMember)*
TypeMember <- ("+" / "-")? "readonly"? "[" ID "in" Type ("as" Type)? "]" (("+" / "-")? "?")? TypeAnn? / IndexSig / "new"? TypeParams? Params TypeAnn? / (("get" / "set" / "readonly") !("(" / ":" / "?" / "," / ";"))? PropName "?"? (TypeParams? Params (":" ReturnType)? / TypeAnn?) &("," / ";" / NL / "}")
IndexSig <- "readonly"? "[" ID ":" Type "]" TypeAnn
Generic <- TypeArgs &("(" / STR) / "!" !"="
Cast <- ("as" / "satisfies") ("const" / Type) (BinOp Unary)*
TypeDecl <- "declare" (VarDeclare / Function / Class / TypeDecl / ("module" / "namespace") (ID ("." ID)* / STR) ModuleBody) / "type" ID TypeParams? "=" Type Semi / "interface" ID TypeParams? ("extends" Type ("," Type)*)? "{" TypeMembers "}" / "const"? "enum" ID "{" (PropName ("=" Expr)? ("," PropName ("=" Expr)?)* ","?)? "}" / ("namespace" / "module") ID ("." ID)* ModuleBody / "abstract" Class
VarDeclare <- ("const" / "let" / "var") ID TypeAnn? ("," ID TypeAnn?)* Semi
ModuleBody <- "{" (NL / Import / Export / StmtT)* "}"
"""


def _js(name: str, only: str) -> Language:
    grammar = "Program <- (NL / Import / Export / StmtT)*\n" + _JS_STATEMENT.replace("@", "T") + _JS_STATEMENT.replace("@", "F") + _JS_COMMON + only
    return _build(name, _JS_LEX, _JS_EARLY, r"[ \t]+|//[^\n]*", _JS_WORDS, _JS_SOFT, _JS_SIGNS, grammar, ("//", "/*"), "\"'`", _js_extra, _js_arrange)


# Go -----------------------------------------------------------------------------------------------------------

_GO_LEX = rf"[ \t\r]+|\n|{_NAME}|{_SLASH}|{_CONFLICT}|{_DQ}|`[^`]*`|{_SQ}|{_NAME}|{_NUMBER}|\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|<<|>>|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|[\s\S]"
_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_GO_SIGNS = _SIGNS_C + " ... <<= >>= &^= &^ <- := << >> ++ -- && || == != <= >= += -= *= /= %= &= |= ^="


def _go_extra(token: str) -> str | None:
    if token == "\n" or (token.startswith("/*") and "\n" in token):
        return LINE
    return None


def _go_arrange(table: dict[str, str]):
    ends = "[" + re.escape(ID + NUM + STR + ")]}" + "".join(table[k] for k in ("break", "continue", "fallthrough", "return", "++", "--"))) + "]"
    keep = re.compile(rf"(?<={ends})N")

    def arrange(tokens: list[str], kinds: list[str]) -> tuple[str, object]:
        return keep.sub(_KEPT, "".join(kinds)).replace(LINE, "").replace(_KEPT, LINE), _Lazy(kinds, keep)

    return arrange


# ~ stands for the control headers, where a composite literal of a plain type can't stand.
_GO_EXPR = """
Expr~ <- Unary~ (BinOp Unary~)*
Unary~ <- ("+" / "-" / "!" / "^" / "*" / "&" / "<-")* Primary~
Primary~ <- Operand~ Postfix*
"""
_GO = (
    """
Program <- NL* "package" ID T ImportDecl* Top*
T <- (";" / NL)+ / !. / &"}" / &")"
ImportDecl <- "import" ("(" (NL / ";")* (ImportSpec T)* ")" / ImportSpec) T
ImportSpec <- (ID / ".")? STR
Top <- (Func / ConstDecl / VarDecl / TypeDecl) T
Func <- "func" ("(" Parameter? ","? ")")? ID TypeParams? Signature Block?
TypeParams <- "[" ID ("," ID)* Constraint ("," ID ("," ID)* Constraint)* "]"
Constraint <- "~"? Type ("|" "~"? Type)*
Signature <- Parameters (Parameters / Type)?
Parameters <- "(" (Parameter ("," Parameter)* ","? NL?)? ")"
Parameter <- ID ("," ID)* "..."? Type / "..."? Type
ConstDecl <- "const" ("(" (NL / ";")* (ConstSpec T)* ")" / ConstSpec)
ConstSpec <- Ids (Type? "=" ExprList)?
VarDecl <- "var" ("(" (NL / ";")* (VarSpec T)* ")" / VarSpec)
VarSpec <- Ids (Type ("=" ExprList)? / "=" ExprList)
TypeDecl <- "type" ("(" (NL / ";")* (TypeSpec T)* ")" / TypeSpec)
TypeSpec <- ID TypeParams? "="? Type
Ids <- ID ("," ID)*
Type <- TypeName TypeArgs? / "*" Type / "[" ("..." / Expr)? "]" Type / "map" "[" Type "]" Type / "chan" "<-"? Type / "<-" "chan" Type / "func" Signature / StructType / InterfaceType / "(" Type ")"
TypeName <- ID ("." ID)?
TypeArgs <- "[" Type ("," Type)* "]"
StructType <- "struct" "{" (NL / ";")* (Field T)* "}"
Field <- (Ids Type / "*"? TypeName TypeArgs?) STR?
InterfaceType <- "interface" "{" (NL / ";")* ((ID Signature / Constraint) T)* "}"
Block <- "{" Stmts "}"
Stmts <- (NL / ";" / Stmt &(NL / ";" / "}"))*
Stmt <- FlatStmt / ConstDecl / VarDecl / TypeDecl / Block / If / For / Switch / Select / "return" ExprList? / ("break" / "continue") ID? / "goto" ID / "fallthrough" / ("go" / "defer") Expr / ID ":" !"=" (NL* Stmt)? / SimpleStmt
SimpleStmt <- ExprList ((":=" / AssignOp) ("range" Expr / ExprList) / "++" / "--" / "<-" Expr)?
SimpleH <- ExprListH ((":=" / AssignOp) ExprListH / "++" / "--" / "<-" ExprH)?
AssignOp <- "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">>=" / "&^="
If <- "if" (SimpleH? ";" SimpleH / SimpleH) Block ("else" (If / Block))?
For <- "for" ((Ids2 (":=" / "="))? "range" ExprH / SimpleH? ";" ExprH? ";" SimpleH? / ExprH)? Block
Ids2 <- ExprH ("," ExprH)?
Switch <- "switch" (SimpleH? ";")? (ID ":=")? (Primary2 / ExprH)? "{" (NL / ";")* (("case" CaseList / "default") ":" Stmts)* "}"
Primary2 <- PrimaryH "." "(" "type" ")" / PrimaryH &"{"
CaseList <- CaseItem ("," CaseItem)*
CaseItem <- Expr / Type
Select <- "select" "{" (NL / ";")* (("case" SimpleStmt / "default") ":" Stmts)* "}"
ExprList <- Expr ("," Expr)*
ExprListH <- ExprH ("," ExprH)*
BinOp <- "||" / "&&" / "==" / "!=" / "<=" / ">=" / "<<" / ">>" / "&^" / "<" / ">" / "+" / "-" / "*" / "/" / "%" / "&" / "|" / "^"
"""
    + _GO_EXPR.replace("~", "")
    + _GO_EXPR.replace("~", "H")
    + """
Operand <- NUM / STR / "func" Signature Block / "(" (Expr / Type) ")" / Literal / TypeName / Type
OperandH <- NUM / STR / "func" Signature Block / "(" (Expr / Type) ")" / LiteralH / TypeName / Type
Literal <- (("[" ("..." / Expr)? "]" Type / "map" "[" Type "]" Type / StructType) / TypeName TypeArgs?) LitValue
LiteralH <- ("[" ("..." / Expr)? "]" Type / "map" "[" Type "]" Type / StructType) LitValue
LitValue <- "{" (NL* Element ("," Element)* ","?)? "}"
Element <- (LitValue / Expr) (":" (LitValue / Expr))?
Postfix <- FlatCall / "." (ID / "(" ("type" / Type) ")") / "(" (CallArg ("," CallArg)* "..."? ","?)? ")" / "[" Expr? (":" Expr?)? (":" Expr?)? "]" / TypeArgs
FlatCall <- "(" (FlatArg ("," FlatArg)*)? ")"
FlatArg <- (NUM / STR / ID ("." ID)*)
FlatStmt <- (ID ("," ID)* (":=" / "=") / "defer" / "return")? (FlatArg "(" (FlatArg2 ("," FlatArg2)*)? ")" / FlatArg !(":")) &(NL / ";" / "}")
FlatArg2 <- FlatArg FlatCall?
CallArg <- Expr / Type
""")

# Java ---------------------------------------------------------------------------------------------------------

_JAVA_LEX = rf'\s+|(?:[^\W\d]|\$)[\w$]*|{_SLASH}|{_CONFLICT}|"""(?:[^\\"]|\\[\s\S]|"(?!""))*"""|{_DQ}|{_SQ}|(?:[^\W\d]|\$)[\w$]*|{_NUMBER}|>>>=|>>=|<<=|\.\.\.|::|->|\+\+|--|&&|\|\||<<|[=!<+\-*/%&|^]=|[\s\S]'
_JAVA_WORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
_JAVA_SOFT = "var record sealed permits yield when module open"
_JAVA_SIGNS = _SIGNS_C + " >>>= >>= <<= ... :: -> ++ -- && || << == != <= += -= *= /= %= &= |= ^="
_JAVA = """
Program <- ("package" Name ";" / Annotation+ "package" Name ";")? ("import" "static"? Name ("." "*")? ";" / ";")* (TypeDecl / ";")*
Name <- ID ("." ID)*
Annotation <- "@" !"interface" Name ("(" (AnnoPair ("," AnnoPair)* ","? / AnnoValue)? ")")?
AnnoPair <- ID "=" AnnoValue
AnnoValue <- Annotation / "{" (AnnoValue ("," AnnoValue)* ","?)? "}" / Cond
Modifiers <- (Annotation / Modifier)*
Modifier <- "public" / "private" / "protected" / "static" / "final" / "abstract" / "native" / "synchronized" / "transient" / "volatile" / "strictfp" / "default" !":" / "sealed" !("(" / "=" / ".") / ID "-" "sealed"
TypeDecl <- Modifiers (Class / Interface / Enum / Record / AnnoType)
Class <- "class" ID TypeParams? ("extends" Type)? ("implements" Types)? ("permits" Types)? ClassBody
Interface <- "interface" ID TypeParams? ("extends" Types)? ("permits" Types)? ClassBody
Enum <- "enum" ID ("implements" Types)? "{" (EnumConst ("," EnumConst)* ","?)? (";" Member*)? "}"
EnumConst <- Annotation* ID Args? ClassBody?
Record <- "record" ID TypeParams? Params ("implements" Types)? ClassBody
AnnoType <- "@" "interface" ID "{" (TypeDecl / Modifiers Type ID "(" ")" ("default" AnnoValue)? ";" / Member)* "}"
Types <- Type ("," Type)*
TypeParams <- "<" Annotation* ID ("extends" Type ("&" Type)*)? ("," Annotation* ID ("extends" Type ("&" Type)*)?)* ">"
ClassBody <- "{" Member* "}"
Member <- ";" / "static"? Block / Modifiers (Class / Interface / Enum / Record / AnnoType / TypeParams? (Method / Constructor) / Fields)
Method <- ("void" / Type) ID Params Dims Throws? (Block / ";") / ("void" / Type) ID "(" ")" "default" AnnoValue ";"
Constructor <- ID Params? Throws? Block
Throws <- "throws" Types
Fields <- Type VarDecls ";"
VarDecls <- VarDecl ("," VarDecl)*
VarDecl <- ID Dims ("=" Init)?
Init <- ArrayInit / Expr
ArrayInit <- "{" (Init ("," Init)* ","?)? "}"
Dims <- (Annotation* "[" "]")*
Params <- "(" (Param ("," Param)*)? ")"
Param <- Modifiers Type "..."? (ID ".")* (ID / "this") Dims
Primitive <- "int" / "long" / "boolean" / "char" / "byte" / "short" / "float" / "double"
Type <- Annotation* (Primitive / ID TypeArgs? ("." Annotation* ID TypeArgs?)*) Dims
TypeArgs <- "<" (TypeArg ("," TypeArg)*)? ">"
TypeArg <- Annotation* "?" (("extends" / "super") Type)? / Type
Block <- "{" Stmt* "}"
Stmt <- Block / ";" / FlatStmt / LocalVar ";" / "if" "(" Expr ")" Stmt ("else" Stmt)? / For / "while" "(" Expr ")" Stmt / "do" Stmt "while" "(" Expr ")" ";" / Try / Switch / "synchronized" "(" Expr ")" Block / "return" Expr? ";" / "throw" Expr ";" / ("break" / "continue") ID? ";" / "yield" Expr ";" / "assert" Expr (":" Expr)? ";" / ID ":" Stmt / Modifiers (Class / Interface / Enum / Record) / StmtExpr ";"
FlatStmt <- ((Primitive / ID)? ID "=" / "return")? ID ("." ID)* "(" (FlatArg2 ("," FlatArg2)*)? ")" ";"
FlatArg2 <- (NUM / STR / "this" / ID ("." ID)*) FlatCall? &("," / ")")
FlatArg <- (NUM / STR / "this" / ID ("." ID)*) &("," / ")")
StmtExpr <- ("++" / "--") Unary / Left (AssignOp Expr / "++" / "--" / !("?" / BinOp)) 
LocalVar <- Modifiers Type VarDecls
For <- "for" "(" (Modifiers Type ID ":" Expr / (LocalVar / StmtExpr ("," StmtExpr)*)? ";" Expr? ";" (StmtExpr ("," StmtExpr)*)?) ")" Stmt
Try <- "try" ("(" Resource (";" Resource)* ";"? ")" Block Catch* Finally? / Block (Catch+ Finally? / Finally))
Resource <- Modifiers Type ID "=" Expr / Left
Catch <- "catch" "(" Modifiers Type ("|" Type)* ID ")" Block
Finally <- "finally" Block
Switch <- "switch" "(" Expr ")" "{" (Label (":" Stmt* / "->" (Block / "throw" Expr ";" / Expr ";")))* "}"
Label <- "case" CaseItem ("," CaseItem)* ("when" Expr)? / "default"
CaseItem <- "default" / Pattern / Cond
Pattern <- Modifiers Type (ID / "(" (Pattern ("," Pattern)*)? ")")
Expr <- Lambda / Cond (AssignOp Expr)?
AssignOp <- "=" / ">>>=" / ">>=" / "<<=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^="
Lambda <- (ID / "(" (ID ("," ID)*)? ")" / Params) "->" (Block / Expr)
Cond <- Binary ("?" (Lambda / Expr) ":" (Lambda / Cond))?
Binary <- Unary ("instanceof" "final"? (Pattern / Type) / BinOp Unary)*
BinOp <- "||" / "&&" / "==" / "!=" / "<=" / ">" "=" / "<<" / ">" ">" ">" / ">" ">" / "<" / ">" / "+" / "-" / "*" / "/" / "%" / "&" / "|" / "^"
Unary <- ("+" / "-" / "++" / "--" / "!" / "~") Unary / Cast / Left ("++" / "--")*
Cast <- "(" Primitive Dims ")" Unary / "(" Type ("&" Type)* ")" (Lambda / !("+" / "-" / "++" / "--") Unary)
Left <- Atom Tail*
Tail <- "." (TypeArgs? ID / "this" / "class" / "new" New / TypeArgs? "super") / FlatCall / Args / "[" Expr "]" / "::" TypeArgs? (ID / "new")
FlatCall <- "(" (FlatArg ("," FlatArg)*)? ")"
Args <- "(" (Expr ("," Expr)*)? ")"
Atom <- NUM / STR / "true" / "false" / "null" / "this" / "super" / "new" New / Switch / "(" Expr ")" / (Primitive / "void") Dims "." "class" / (Primitive Dims / ID TypeArgs ("." ID TypeArgs?)* Dims / ID ("." ID)* ("[" "]")+) &"::" / ID ("." ID)* ("[" "]")+ "." "class" / Primitive Dims / ID
New <- Annotation* (Primitive / ID TypeArgs? ("." ID TypeArgs?)*) (("[" Expr "]")+ Dims / ("[" "]")+ ArrayInit / Args ClassBody?)
"""

# C ------------------------------------------------------------------------------------------------------------

_C_LEX = rf"\s+|{_SLASH}|{_CONFLICT}|(?m:^[ \t]*#(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*)|(?:L|u8|u|U)?{_DQ}|(?:L|u|U)?{_SQ}|{_NAME}|{_NUMBER}|<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||<<|>>|[=!<>+\-*/%&|^]=|[\s\S]"
_C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Alignof _Static_assert _Noreturn _Atomic"
_C_SOFT = "bool __attribute__ asm"
_C_SIGNS = _SIGNS_C + " <<= >>= ... -> ++ -- && || << >> == != <= >= += -= *= /= %= &= |= ^="


def _c_extra(token: str) -> str | None:
    stripped = token.lstrip(" \t")
    if stripped.startswith("#") and len(stripped) > 1 or (stripped == "#" and len(token) > 1):
        return "" if _DIRECTIVE.match(stripped) else BAD
    if stripped == "#":
        return ""
    return None


# A hash line must be a directive (or empty); a comment of another language is none.
_DIRECTIVE = re.compile(r"#\s*(?:include|include_next|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|line|error|warning|pragma|ident|import)\b|#\s*$|#\s*\d+\s+\"")
_C = """
Program <- (Top / ";")*
Top <- FuncDef / Declaration
FuncDef <- Specs Declarator Attr* (Declaration)* Block
Declaration <- "_Static_assert" "(" Exprs ")" ";" / Specs (InitDecl ("," InitDecl)*)? Attr* ";"
Specs <- Attr* Qualifier* (Builtin (Builtin / Qualifier)* / Struct Qualifier* / Enum Qualifier* / ID Qualifier* &(ID / "*" / "(" / ";" / ")" / "," / ":" / "["))
Attr <- "__attribute__" "(" "(" Balanced* ")" ")" / "asm" "(" Balanced* ")"
Balanced <- "(" Balanced* ")" / !(")" / "(") .
Qualifier <- "const" / "volatile" / "static" / "extern" / "inline" / "register" / "auto" / "restrict" / "typedef" / "_Noreturn" / "_Atomic" / Attr
Builtin <- "void" / "char" / "short" / "int" / "long" / "float" / "double" / "signed" / "unsigned" / "_Bool" / "bool"
Struct <- ("struct" / "union") Attr* (ID? "{" (Specs (Field ("," Field)*)? Attr* ";" / ";")* "}" Attr* / ID)
Field <- Declarator (":" Cond)? / ":" Cond
Enum <- "enum" (ID? "{" (ID ("=" Cond)? ("," ID ("=" Cond)?)* ","?)? "}" / ID)
InitDecl <- Declarator Attr* ("=" Init)?
Init <- "{" (InitItem ("," InitItem)* ","?)? "}" / Expr
InitItem <- (("." ID / "[" Cond "]")+ "=")? Init
Pointer <- ("*" Qualifier*)*
Declarator <- Pointer (ID / "(" Attr* Declarator ")") Suffix*
Suffix <- "[" ("static" / Qualifier)* ("*" / Expr)? "]" / "(" ParamList? ")"
ParamList <- "void" &")" / Param ("," Param)* ("," "...")?
Param <- Specs (Declarator / Abstract)?
Abstract <- ("*" Qualifier*)+ AbsTail* / AbsTail+
AbsTail <- "(" Abstract ")" / "[" Expr? "]" / "(" ParamList? ")"
TypeName <- Specs Abstract?
Block <- "{" (Stmt / Declaration)* "}"
Stmt <- FlatStmt / Block / ";" / "if" "(" Exprs ")" Stmt ("else" Stmt)? / "while" "(" Exprs ")" Stmt / "do" Stmt "while" "(" Exprs ")" ";" / "for" "(" (Declaration / Exprs? ";") Exprs? ";" Exprs? ")" Stmt / "switch" "(" Exprs ")" Stmt / "case" Cond ("..." Cond)? ":" (Stmt / Declaration)? / "default" ":" (Stmt / Declaration)? / "return" Exprs? ";" / ("break" / "continue") ";" / "goto" ID ";" / ID ":" (Stmt / Declaration / &"}") / Attr ";" / !DeclStart Exprs ";"
DeclStart <- ID ("*"+ ID ("=" / ";" / "," / "[") / ID)
Exprs <- Expr ("," Expr)*
Expr <- Cond (AssignOp Expr)?
AssignOp <- "=" / "<<=" / ">>=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^="
Cond <- Binary ("?" Exprs? ":" Cond)?
Binary <- Unary (BinOp Unary)*
BinOp <- "||" / "&&" / "==" / "!=" / "<=" / ">=" / "<<" / ">>" / "<" / ">" / "+" / "-" / "*" / "/" / "%" / "&" / "|" / "^"
Unary <- ("++" / "--") Unary / ("&&" ID) / ("&" / "*" / "+" / "-" / "~" / "!") Unary / ("sizeof" / "_Alignof") ("(" TypeName ")" / Unary) / Cast / Postfix
Cast <- "(" TypeName ")" ("{" (InitItem ("," InitItem)* ","?)? "}" / !("+" / "-" / "&" / "*") Unary / &("(" (Builtin / Qualifier / "struct" / "union" / "enum" / ID "*")) Unary) / "(" (Qualifier / Builtin / "struct" / "union" / "enum") Balanced* ")" Unary
Postfix <- Atom Tail*
Tail <- FlatCall / "(" (CallArg ("," CallArg)*)? ")" / "[" Exprs "]" / ("." / "->") ID / "++" / "--"
FlatCall <- "(" (FlatArg ("," FlatArg)*)? ")"
FlatArg <- (NUM / STR / ID (("." / "->") ID)*) &("," / ")")
FlatStmt <- ((Builtin)? ID (("." / "->") ID)* "=" / "return")? ID "(" (FlatArg2 ("," FlatArg2)*)? ")" ";"
FlatArg2 <- ("&"? ID (("." / "->") ID)* FlatCall? / NUM / STR) &("," / ")")
CallArg <- Expr / TypeName
Atom <- ID / NUM / STR (STR / ID)* / "(" Exprs ")" / "(" Block ")"
"""

# Rust ---------------------------------------------------------------------------------------------------------

_RUST_COMMENT = r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)*\*/"
_RUST_LEX = (
    rf'\s+|{_RUST_COMMENT}|{_CONFLICT}|b?r"[^"]*"|b?r#"(?:[^"]|"(?!#))*"#|b?r##"(?:[^"]|"(?!##))*"##|[bc]?"(?:[^"\\]|\\[\s\S])*"'
    rf"|b?'(?:[^'\\\n]|\\(?:[^u\n]|u\{{[0-9a-fA-F_]+\}})(?:[0-9a-fA-F])?)'|'{_NAME}|r#{_NAME}|{_NAME}"
    r"|(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)\w*|\.\.=|\.\.\.|<<=|\.\.|::|->|=>|&&|\|\||<<|[=!<+\-*/%&|^]=|[\s\S]")
_RUST_WORDS = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn"
_RUST_SOFT = "union default macro_rules auto"
_RUST_SIGNS = _SIGNS_C + " ..= ... <<= .. :: -> => && || << == != <= += -= *= /= %= &= |= ^= $"


def _rust_extra(token: str) -> str | None:
    if token[0] == "'" and token[-1] != "'":
        return "L"  # a lifetime
    if len(token) > 2 and token.startswith("r#") and token[-1] not in "\"#":
        return ID
    return None


_RUST_EXPR = """
Expr~ <- Leaf &(")" / "," / ";" / "]" / "}") / Range~ (AssignOp Expr~)?
Range~ <- (".." / "..=") Or~? / Or~ ((".." / "..=") Or~?)?
Or~ <- Unary~ ("as" Type / BinOp Unary~)*
Unary~ <- ("-" / "!" / "*" / "&&" "mut"? / "&" "mut"?) Unary~ / Postfix~
Postfix~ <- Atom~ Tail*
"""
_RUST = (
    """
Program <- InnerAttr* Item*
InnerAttr <- "#" "!" "[" Tree* "]"
Attr <- "#" "[" Tree* "]"
Tree <- "(" Tree* ")" / "[" Tree* "]" / "{" Tree* "}" / !("(" / ")" / "[" / "]" / "{" / "}") .
Item <- Attr* ("macro_rules" "!" ID ("{" Tree* "}" / "(" Tree* ")" ";"? / "[" Tree* "]" ";"?) / Vis? (Use / Mod / Fn / Struct / Union / EnumDef / Impl / Trait / TypeAlias / Const / Static / ExternItem) / MacroItem)
Vis <- "pub" ("(" ("in"? Path / "crate" / "self" / "super") ")")?
Use <- "use" UseTree ";" / "extern" "crate" (ID / "self") ("as" ID)? ";"
UseTree <- "::"? (UsePath "::")? ("*" / "{" (UseTree ("," UseTree)* ","?)? "}") / "::"? UsePath ("as" ID)?
UsePath <- PathWord ("::" PathWord)*
PathWord <- ID / "crate" / "self" / "super" / "Self"
Mod <- "unsafe"? "mod" ID (";" / "{" InnerAttr* Item* "}")
FnHead <- "const"? "async"? "unsafe"? ("extern" STR?)? "fn" ID Generics? "(" (FnSelf ("," Param)* ","? / Param ("," Param)* ("," "...")? ","?)? ")" ("->" Type)? Where?
Fn <- "default"? FnHead (Block / ";")
FnSelf <- Attr* ("&" "L"? "mut"? "self" / "mut"? "self" (":" Type)?)
Param <- Attr* Pattern ":" Type / Attr* Type
Generics <- "<" (GenericParam ("," GenericParam)* ","?)? ">"
GenericParam <- Attr* ("L" (":" ("L" ("+" "L")*)?)? / "const" ID ":" Type ("=" (Block / NUM / ID))? / ID (":" Bounds?)? ("=" Type)?)
Bounds <- Bound ("+" Bound)* "+"?
Bound <- "L" / "?"? ForLife? Path / "(" "?"? ForLife? Path ")" / "~" "const" Path
ForLife <- "for" Generics
Where <- "where" (WhereItem ("," WhereItem)* ","?)?
WhereItem <- "L" ":" Bounds / ForLife? Type ":" Bounds?
Struct <- "struct" ID Generics? (Where? "{" (Field ("," Field)* ","?)? "}" / "(" (TupleField ("," TupleField)* ","?)? ")" Where? ";" / Where? ";")
Union <- "union" ID Generics? Where? "{" (Field ("," Field)* ","?)? "}"
Field <- Attr* Vis? ID ":" Type
TupleField <- Attr* Vis? Type
EnumDef <- "enum" ID Generics? Where? "{" (Variant ("," Variant)* ","?)? "}"
Variant <- Attr* Vis? ID ("{" (Field ("," Field)* ","?)? "}" / "(" (TupleField ("," TupleField)* ","?)? ")")? ("=" Expr)?
Impl <- "unsafe"? "default"? "impl" Generics? "const"? ("!"? Type "for")? Type Where? "{" InnerAttr* Assoc* "}"
Trait <- "unsafe"? "auto"? "trait" ID Generics? (":" Bounds?)? Where? ("{" InnerAttr* Assoc* "}" / "=" Bounds ";")
Assoc <- Attr* Vis? "default"? (Fn / "type" ID Generics? (":" Bounds)? Where? ("=" Type)? Where? ";" / "const" ID ":" Type ("=" Expr)? ";" / MacroItem)
TypeAlias <- "type" ID Generics? Where? "=" Type Where? ";"
Const <- "const" ID ":" Type "=" Expr ";"
Static <- "static" "mut"? ID ":" Type ("=" Expr)? ";"
ExternItem <- "unsafe"? "extern" STR? "{" InnerAttr* (Attr* Vis? (FnHead ";" / "static" "mut"? ID ":" Type ";" / "type" ID ";"))* "}"
MacroItem <- Path "!" ID? ("{" Tree* "}" / ("(" Tree* ")" / "[" Tree* "]") ";")
Leaf <- NUM / STR / ID ("." ID)*
Type <- ID &(")" / "," / ";" / "{" / "=" / ">") / "(" (Type ("," Type)* ","?)? ")" / "!" / "*" ("const" / "mut") Type / ("&&" / "&") "L"? "mut"? Type / "[" Type (";" Expr)? "]" / ForLife? "unsafe"? ("extern" STR?)? "fn" "(" (FnTypeParam ("," FnTypeParam)* ","?)? ")" ("->" Type)? / ("impl" / "dyn") Bounds / Path "!" ("(" Tree* ")" / "[" Tree* "]" / "{" Tree* "}") / Path ("+" Bounds)?
FnTypeParam <- (ID ":")? Type
Path <- ("<" Type ("as" Path)? ">" "::")? "::"? PathSeg ("::" PathSeg)*
PathSeg <- PathWord ("::"? GenericArgs / "(" (Type ("," Type)* ","?)? ")" ("->" Type)?)?
GenericArgs <- "<" (GenericArg ("," GenericArg)* ","?)? ">"
GenericArg <- "L" / ID GenericArgs? ("=" Type / ":" Bounds) / Type / "-"? NUM / STR / "true" / "false" / Block
Block <- "{" InnerAttr* Stmt* Expr? "}"
Stmt <- FlatStmt / ";" / Let / Attr* BlockLike !(Tail2) / Item / Attr* Expr ";"
Tail2 <- "." / "?"
FlatStmt <- ("let" ID "=" / "return")? ID ("." ID / "::" ID)* "(" (FlatArg2 ("," FlatArg2)*)? ")" ";"
FlatArg2 <- "&"? (NUM / STR / ID ("." ID)*) FlatCall? &("," / ")")
FlatArg <- "&"? (NUM / STR / ID ("." ID)*) &("," / ")")
Let <- Attr* "let" Pattern (":" Type)? ("=" Expr ("else" Block)?)? ";"
BlockLike <- ("L" ":")? ("loop" Block / "while" Cond Block / "for" Pattern "in" ExprH Block / Block) / "unsafe" Block / If / Match / "async" "move"? Block / "const" Block / MacroBrace
MacroBrace <- Path "!" "{" Tree* "}"
If <- "if" Cond Block ("else" (If / Block))?
Cond <- CondItem ("&&" CondItem)*
CondItem <- "let" Pattern "=" UnaryH (!"&&" BinOp UnaryH)* / ExprH
Match <- "match" ExprH "{" InnerAttr* (Arm)* "}"
Arm <- Attr* Pattern ("if" Cond)? "=>" (BlockLike &("}" / "|" / ID / "L" / NUM / STR / "#" / "(" / "[" / "&" / "-" / "ref" / "mut" / "_" / "Self" / "self" / "crate" / "super" / "true" / "false" / "..=") / Expr (",") / Expr &"}" / BlockLike ",")  ","?
Pattern <- "|"? PatternOne ("|" PatternOne)*
PatternOne <- "ref"? "mut"? ID "@" PatternOne / ("&&" / "&") "mut"? PatternOne / "ref" "mut"? ID / "mut" ID / "(" (Pattern ("," Pattern)* ","?)? ")" / "[" (Pattern ("," Pattern)* ","?)? "]" / ".." / RangePat / Path "!" ("(" Tree* ")" / "[" Tree* "]") / Path ("(" (Pattern ("," Pattern)* ","?)? ")" / "{" (FieldPat ("," FieldPat)* ","?)? "}")? / Lit / "_"
RangePat <- (Lit / Path) ("..=" / "..." / "..") (Lit / Path)? / "..=" (Lit / Path)
FieldPat <- Attr* (".." / (ID / NUM) ":" Pattern / "ref"? "mut"? ID)
Lit <- "-"? NUM / STR / "true" / "false"
AssignOp <- "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">" ">" "="
BinOp <- "||" / "&&" / "==" / "!=" / "<=" / ">" "=" / "<<" / ">" ">" !"=" / "<" / ">" / "+" / "-" / "*" / "/" / "%" / "&" / "|" / "^"
"""
    + _RUST_EXPR.replace("~", "")
    + _RUST_EXPR.replace("~", "H")
    + """
Atom <- StructLit / AtomH
AtomH <- NUM / STR / "true" / "false" / BlockLike / Closure / "return" Expr? / "break" "L"? Expr? / "continue" "L"? / "(" (Expr ("," Expr)* ","?)? ")" / "[" (Expr (";" Expr / ("," Expr)* ","?))? "]" / Path "!" ("(" Tree* ")" / "[" Tree* "]" / "{" Tree* "}") / PathExpr / "_"
PathExpr <- ("<" Type ("as" Path)? ">" "::")? "::"? ExprSeg ("::" ExprSeg)*
ExprSeg <- PathWord ("::" GenericArgs)?
StructLit <- PathExpr "{" (FieldInit ("," FieldInit)* ","?)? "}"
FieldInit <- Attr* (".." Expr? / (ID / NUM) (":" Expr)?)
Closure <- "static"? "async"? "move"? ("||" / "|" (ClosureParam ("," ClosureParam)* ","?)? "|") ("->" Type Block / Expr)
ClosureParam <- PatternOne (":" Type)?
Tail <- "?" / "." ("await" / NUM / ID ("::" GenericArgs)?) / FlatCall / "(" (Expr ("," Expr)* ","?)? ")" / "[" Expr "]"
FlatCall <- "(" (FlatArg ("," FlatArg)*)? ")"
""")

# Python -------------------------------------------------------------------------------------------------------

_PY_STRING = r"(?:[rRbBuUfFtT]{0,3})(?:\"\"\"[^\\\"]*+(?:(?:\\[\s\S]|\"(?!\"\"))[^\\\"]*+)*+\"\"\"|'''[^\\']*+(?:(?:\\[\s\S]|'(?!''))[^\\']*+)*+'''|" + _DQ + "|" + _SQ + ")"


def _f_string(quote: str, depth: int) -> str:
    """A formatted string on one line, whose fields may hold strings with the same quotes."""
    inner = "|".join(_f_string(q, depth - 1) for q in "'\"") + "|" if depth else ""
    field = rf"\{{(?:{inner}[^{{}}'\"\n]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|\{{[^{{}}\n]*\}})*\}}"
    return rf"(?:[fF][rR]?|[rR][fF]){quote}(?!{quote}{quote})(?:[^{quote}\\\n{{]|\\.|\{{\{{|{field})*{quote}"


_PY_FORMATTED = "|".join(_f_string(q, 1) for q in "'\"")
_PY_LEX = rf"[ \t\f]+|\\\r?\n|(?:\r?\n|\r)[ \t\f]*|#[^\n\r]*|{_CONFLICT}|{_PY_FORMATTED}|{_PY_STRING}|{_NAME}|{_NUMBER}|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|[=!<>+\-*/%&|^@]=|[\s\S]"
_PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
_PY_SOFT = "match case type"
_PY_SIGNS = "( ) [ ] { } , ; : . @ ~ + - * / % & | ^ = < > **= //= >>= <<= ... -> := ** // << >> == != <= >= += -= *= /= %= &= |= ^= @="


def _py_extra(token: str) -> str | None:
    if token[0] in "\n\r":
        return LINE
    if token[0] == "\\" and len(token) > 1:
        return ""
    if token[0] == "\f":
        return ""
    if token[0] == "0" and _ZEROS.fullmatch(token):
        return BAD
    return None


# A whole number that begins with 0 and isn't 0.
_ZEROS = re.compile(r"0[0-9_]*[1-9][0-9_]*")


def _py_arrange(table: dict[str, str]):
    @functools.lru_cache(10_000)
    def width(token: str) -> int:
        n = 0
        for c in token:
            if c == "\t":
                n = n // 8 * 8 + 8
            elif c == " ":
                n += 1
            elif c in "\n\r\f":
                n = 0
        return n

    def arrange(tokens: list[str], kinds: list[str]) -> tuple[str, object]:
        out: list[str] = []
        indents, depth, at = [0], 0, 0
        lead = width(tokens[0]) if tokens and tokens[0][0] in " \t" else 0
        ends = [k for k, v in enumerate(kinds) if v == LINE]
        ends.append(len(kinds))
        fresh = True
        for end in ends:
            line = "".join(kinds[at:end])
            if line:
                if fresh:
                    if lead > indents[-1]:
                        indents.append(lead)
                        out.append(INDENT)
                    while lead < indents[-1]:
                        indents.pop()
                        out.append(DEDENT)
                    if lead != indents[-1]:
                        out.append(BAD)
                out.append(line)
                for a in "([{":
                    depth += line.count(a)
                for a in ")]}":
                    depth -= line.count(a)
                fresh = depth <= 0
                if fresh:
                    depth = 0
                    out.append(LINE)
            if end < len(kinds) and fresh:
                lead = width(tokens[end])
            at = end + 1
        out.append(DEDENT * (len(indents) - 1))
        return "".join(out), _PyWhere(kinds)

    return arrange


class _PyWhere:
    """Kinds of indentation have no token; the n-th other kind is the n-th token that has one."""

    def __init__(self, kinds: list[str]):
        self.real = [k for k, v in enumerate(kinds) if v and v != LINE]
        self.total = len(kinds)

    def after(self, string: str, at: int) -> int:
        n = sum(c not in (INDENT, DEDENT, LINE) for c in string[:at])
        return self.real[n] if n < len(self.real) else self.total


_PY = """
Program <- Line*
Line <- Compound / Simple
Simple <- Small (";" Small)* ";"? NL
Small <- Flat &(NL / ";") / Import / "pass" / "break" / "continue" / "return" Tests? / "raise" (Test ("from" Test)?)? / "global" ID ("," ID)* / "nonlocal" ID ("," ID)* / "del" Targets / "assert" Test ("," Test)? / TypeAlias / Assign / Exprs
Flat <- (ID "=" / "return")? (Dotted "(" (FlatPlain ("," FlatPlain)* ("," FlatNamed)* / FlatNamed ("," FlatNamed)*)? ")" / NUM / Dotted)
FlatPlain <- !(ID "=") FlatArg2
FlatNamed <- ID "=" FlatArg2
FlatArg2 <- (NUM / STR / Dotted FlatCall?) &("," / ")")
Dotted <- ID ("." ID)*
FlatCall <- "(" (FlatArg ("," FlatArg)*)? ")"
FlatArg <- (NUM / STR / Dotted) &("," / ")")
TypeAlias <- "type" ID TypeParams? "=" Test
Import <- "import" DottedAs ("," DottedAs)* / "from" (("." / "...")* Dotted / ("." / "...")+) "import" ("*" / "(" ImportAs ("," ImportAs)* ","? ")" / ImportAs ("," ImportAs)*)
DottedAs <- Dotted ("as" ID)?
ImportAs <- ID ("as" ID)?
Targets <- Target ("," Target)* ","?
Target <- "*"? (Place / "(" Targets? ")" / "[" Targets? "]")
Place <- Primary2 &("=" / "," / ")" / "]" / ":" / NL / ";" / AugOp / "in" / "as")
Primary2 <- ID !After / Atom (Trailer &After)* ("." ID / "[" Slice ("," Slice)* ","? "]")
After <- "." / "(" / "["
Assign <- PlaceOne ":" Test ("=" (Yield / Tests))? / PlaceOne AugOp (Yield / Tests) / (Targets "=" !"=")+ (Yield / Tests)
PlaceOne <- Primary2 / "(" PlaceOne ")"
AugOp <- "+=" / "-=" / "*=" / "/=" / "//=" / "%=" / "&=" / "|=" / "^=" / ">>=" / "<<=" / "**=" / "@="
Exprs <- Yield / Tests
Yield <- "yield" ("from" Test / Tests)?
Tests <- StarTest ("," StarTest)* ","?
StarTest <- "*" Or / Named
Named <- ID ":=" Test / Test
Leaf <- NUM / STR / Dotted / "None" / "True" / "False"
Test <- Leaf &(")" / "," / NL / ":" / "]" / "}" / "=") / "lambda" LambdaParams? ":" Test / Disj ("if" Disj "else" Test)?
Disj <- Conj ("or" Conj)*
Conj <- Not ("and" Not)*
Not <- "not" Not / Comp
Comp <- Or (CompOp Or)*
CompOp <- "==" / "!=" / "<=" / ">=" / "<" / ">" / "not" "in" / "in" / "is" "not" / "is"
Or <- Arith (BinOp Arith)*
BinOp <- "|" / "^" / "&" / "<<" / ">>" / "+" / "-" / "**" / "*" / "//" / "/" / "%" / "@"
Arith <- ("+" / "-" / "~")* "await"? Atom Trailer*
Trailer <- "." ID / FlatCall / Call / "[" Slice ("," Slice)* ","? "]"
Call <- "(" (Given ("," Given)* ("," NamedArg)* ("," KeyArg)* ","? / NamedArg ("," NamedArg)* ("," KeyArg)* ","? / KeyArg ("," KeyArg)* ","?)? ")"
Given <- "*" Test / !(ID "=") Named CompFor?
NamedArg <- ID "=" Test / "*" Test
KeyArg <- "**" Test / ID "=" Test
Slice <- "*" Or / Test? ":" Test? (":" Test?)? / Named
Atom <- ID / NUM / STR+ / "None" / "True" / "False" / "..." / "(" (Yield / Named CompFor / Tests)? ")" / "[" (Named CompFor / Tests)? "]" / "{" (DictItem (CompFor / ("," DictItem)* ","?) / Named CompFor / Tests)? "}"
DictItem <- "**" Or / Test ":" Test
CompFor <- ("async"? "for" Targets2 "in" Disj ("if" CompIf)*)+
CompIf <- ID ":=" Disj / Disj
Targets2 <- Target2 ("," Target2)* ","?
Target2 <- "*"? (Arith2 / "(" Targets2 ")" / "[" Targets2 "]")
Arith2 <- ID Trailer*
Compound <- If / While / For / Try / With / Def / Class / Decorated / "async" (Def / With / For) / Match
Suite <- NL INDENT Line+ DEDENT / Simple
If <- "if" Named ":" Suite ("elif" Named ":" Suite)* Else?
Else <- "else" ":" Suite
While <- "while" Named ":" Suite Else?
For <- "for" Targets2 "in" Tests ":" Suite Else?
Try <- "try" ":" Suite (("except" "*"? (Test ("," Test)* ("as" ID)?)? ":" Suite)+ Else? ("finally" ":" Suite)? / "finally" ":" Suite)
With <- "with" ("(" WithItem ("," WithItem)* ","? ")" ":" / WithItem ("," WithItem)* ":") Suite
WithItem <- Test ("as" Target)?
Def <- "def" ID TypeParams? "(" Params? ")" ("->" Test)? ":" Suite
TypeParams <- "[" ("*" / "**")? ID (":" Test)? ("=" Test)? ("," ("*" / "**")? ID (":" Test)? ("=" Test)?)* ","? "]"
Params <- Plain ("," Plain)* ("," Preset)* ("," Rest)? ","? / Preset ("," Preset)* ("," Rest)? ","? / Rest ","?
Plain <- ID (":" Test)? !"=" / "/"
Preset <- ID (":" Test)? "=" Test / "/"
Rest <- "*" ID (":" StarTest)? ("," KeyOnly)* ("," Keys)? / "*" ("," KeyOnly)+ ("," Keys)? / Keys
KeyOnly <- ID (":" Test)? ("=" Test)?
Keys <- "**" ID (":" Test)?
LambdaParams <- LPlain ("," LPlain)* ("," LPreset)* ("," LRest)? ","? / LPreset ("," LPreset)* ("," LRest)? ","? / LRest ","?
LPlain <- ID !"=" / "/"
LPreset <- ID "=" Test / "/"
LRest <- "*" ID ("," LKeyOnly)* ("," LKeys)? / "*" ("," LKeyOnly)+ ("," LKeys)? / LKeys
LKeyOnly <- ID ("=" Test)?
LKeys <- "**" ID
Class <- "class" ID TypeParams? Call? ":" Suite
Decorated <- ("@" Named NL)+ (Def / Class / "async" Def)
Match <- "match" Tests ":" NL INDENT ("case" PatternTop ("if" Named)? ":" Suite)+ DEDENT
PatternTop <- Pattern ("," Pattern)* ","?
Pattern <- "*" ID / PatOr ("as" ID)?
PatOr <- PatOne ("|" PatOne)*
PatOne <- "-"? NUM (("+" / "-") NUM)? / STR+ / "None" / "True" / "False" / Dotted ("(" (PatArg ("," PatArg)* ","?)? ")")? / "(" PatternTop? ")" / "[" PatternTop? "]" / "{" (PatKey ("," PatKey)* ","?)? "}"
PatArg <- (ID "=")? Pattern
PatKey <- "**" ID / Pattern ":" Pattern
"""


def _go() -> Language:
    return _build("Go", _GO_LEX, rf"{_NAME}|{_SINGLE}|{_POINT}", r"[ \t\r]+|//[^\n]*", _GO_WORDS, "", _GO_SIGNS, _GO, ("//", "/*"), "\"'`", _go_extra, _go_arrange)


def _java() -> Language:
    return _build("Java", _JAVA_LEX, rf"[A-Za-z_$][\w$]*|{_SINGLE}|{_POINT}", rf"\s+|{_SLASH}", _JAVA_WORDS, _JAVA_SOFT, _JAVA_SIGNS, _JAVA, ("//", "/*"), "\"'")


def _c() -> Language:
    return _build("C", _C_LEX, rf"[A-Za-z_]\w*+(?![\"'])|{_SINGLE}|{_POINT}", rf"\s+|{_SLASH}", _C_WORDS, _C_SOFT, _C_SIGNS, _C, ("//", "/*"), "\"'", _c_extra)


def _rust() -> Language:
    grammar = _RUST.replace('"L"', "LIFE").replace('"_"', "ID")
    table, names = _table(_RUST_WORDS, _RUST_SOFT, _RUST_SIGNS)
    classes = {"ID": names, "NUM": NUM, "STR": STR, "LIFE": "L"}
    quick = _quick(_RUST_LEX, rf"[A-Za-z_]\w*+(?![\"'#])|{_SINGLE}|{_POINT}", rf"\s+|{_RUST_COMMENT}")
    return Language("Rust", re.compile(_RUST_LEX), quick, Kinds(table, _tell(("//", "/*"), "\"'#", _rust_extra)), Grammar(grammar, table, classes), _plain)


def _python() -> Language:
    return _build("Python", _PY_LEX, rf"[A-Za-z_]\w*+(?![\"'])|{_SINGLE}|{_POINT}", r"[ \t\f]+|#[^\n\r]*", _PY_WORDS, _PY_SOFT, _PY_SIGNS, _PY, ("#",), "\"'", _py_extra, _py_arrange)


_MAKERS = {
    "py": _python, "js": lambda: _js("JavaScript", _JS_ONLY), "ts": lambda: _js("TypeScript", _TS_ONLY), "go": _go, "rs": _rust, "java": _java, "c": _c}
_ALIAS = {"mjs": "js", "jsx": "js"}
_READY: dict[str, Language] = {}


def language_of(extension: str) -> Language | None:
    """The language that a path's extension names, its grammar compiled once per process."""
    key = _ALIAS.get(extension, extension)
    if key not in _MAKERS:
        return None
    if key not in _READY:
        _READY[key] = _MAKERS[key]()
    return _READY[key]
