"""Parsing-expression grammars of the languages, for the syntax of Java 17, Python 3.13 and current JavaScript,
TypeScript and Kotlin. They say which texts are programs, not what they mean: precedence of binary operators is left
out, as it changes no verdict.
"""

from __future__ import annotations

from functools import cache

from auditlake.llm.peg import Grammar

JAVA = """
File = (Annotation* 'package' Name ';')? (Import / ';')* (TypeDecl / ';')* EOF
Import = 'import' 'static'? Name ('.' '*')? ';'
Id = NAME / 'record' / 'sealed' / 'permits' / 'yield' / 'var' / 'non'
Name = Id ('.' Id)*
Annotation = '@' Name AnnArgs?
@AnnArgs = '(' (Id '=' Element (',' Id '=' Element)* / Element)? ')'
Element = ElementList / Annotation / Ternary
@ElementList = '{' (Element (',' Element)*)? ','? '}'
Modifier = 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default'
Mods = (Annotation / Modifier / 'sealed' &(Modifier / Annotation / 'class' / 'interface' / 'abstract') / 'non' '-' 'sealed')*
TypeDecl = Mods (ClassDecl / EnumDecl / RecordDecl / InterfaceDecl / AnnotationDecl)
ClassDecl = 'class' Id TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? ClassBody
EnumDecl = 'enum' Id ('implements' Types)? EnumBody
RecordDecl = 'record' Id TypeParams? Params ('implements' Types)? ClassBody
InterfaceDecl = 'interface' Id TypeParams? ('extends' Types)? ('permits' Types)? ClassBody
AnnotationDecl = '@' 'interface' Id ClassBody
@EnumBody = '{' (EnumItem (',' EnumItem)*)? ','? (';' Member*)? '}'
EnumItem = Annotation* Id Args? ClassBody?
@ClassBody = '{' Member* '}'
Member = ';' / 'static'? Block / TypeDecl / Mods TypeParams? (Id Params Throws? Block / Id Block / ('void' / Type) Id (Params Dims Throws? (Block / ('default' Element)? ';') / Dims ('=' Init)? (',' Declarator)* ';'))
Throws = 'throws' Types
Types = Type (',' Type)*
TypeParams = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Annotation* Id ('extends' Type ('&' Type)*)?
Type = Annotation* (Primitive / ClassType) Dims
Primitive = 'int' / 'long' / 'boolean' / 'double' / 'float' / 'char' / 'byte' / 'short'
ClassType = Id TypeArgs? ('.' Annotation* Id TypeArgs?)*
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg = Annotation* '?' (('extends' / 'super') Type)? / Type
Dims = (Annotation* '[' ']')*
@Params = '(' (Param (',' Param)*)? ')'
Param = (Annotation / 'final')* Type (Annotation* '...')? ((Id '.')* 'this' / Id Dims)
Declarator = Id Dims ('=' Init)?
Init = ArrayInit / Expr
@ArrayInit = '{' (Init (',' Init)*)? ','? '}'
@Block = '{' Statement* '}'
Statement = Block / ';' / 'if' Par Statement ('else' Statement)? / For / 'while' Par Statement / 'do' Statement 'while' Par ';' / Try / Switch / 'synchronized' Par Block
  / 'return' Expr? ';' / 'throw' Expr ';' / 'break' Id? ';' / 'continue' Id? ';' / 'assert' Expr (':' Expr)? ';' / 'yield' !('=' / '.' / '(' / '++' / '--') Expr ';'
  / LocalType / LocalVars ';' / Id ':' Statement / StatementExpr ';'
LocalType = (Annotation / 'final' / 'abstract' / 'static' / 'strictfp')* (ClassDecl / EnumDecl / RecordDecl / InterfaceDecl)
LocalVars = (Annotation / 'final')* Type Declarator (',' Declarator)*
@Par = '(' Expr ')'
For = 'for' ForHead Statement
@ForHead = '(' ((Annotation / 'final')* Type Id ':' Expr / (LocalVars / StatementExpr (',' StatementExpr)*)? ';' Expr? ';' (StatementExpr (',' StatementExpr)*)?) ')'
Try = 'try' (Resources Block Catch* Finally? / Block (Catch+ Finally? / Finally))
@Resources = '(' Resource (';' Resource)* ';'? ')'
Resource = (Annotation / 'final')* Type Id '=' Expr / Primary
Catch = 'catch' CatchHead Block
@CatchHead = '(' (Annotation / 'final')* Type ('|' Type)* Id ')'
Finally = 'finally' Block
Switch = 'switch' Par SwitchBody
@SwitchBody = '{' (Label '->' (Block / 'throw' Expr ';' / Expr ';'))* '}' / '{' (Label ':' Statement*)* '}'
Label = 'case' CaseItem (',' CaseItem)* / 'default'
CaseItem = 'default' / 'null' / Ternary
Args = Arguments
@Arguments = '(' (Expr (',' Expr)*)? ')'
StatementExpr = ('++' / '--') Unary / Atom (Plain* Called)+ (Plain+ ('++' / '--' / AssignOp Expr))? / Atom Plain* ('++' / '--' / AssignOp Expr) / 'new' Creator Suffix* / Id Args Suffix* / ('this' / 'super') Args
Called = '.' Annotation* TypeArgs? Id Args
Plain = '.' TypeArgs? Id !'(' / '.' ('this' / 'super' / 'class') / '[' Expr ']'
Expr = Lambda / Ternary (AssignOp Expr)?
AssignOp = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>='
Ternary = Binary ('?' Expr ':' (Lambda / Ternary))?
Binary = Unary (BinaryOp (Lambda / Unary) / 'instanceof' 'final'? Type Id?)*
BinaryOp = '&&' / '||' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^'
Lambda = (Id / LambdaParams) '->' (Block / Expr)
@LambdaParams = '(' (Id (',' Id)* &')' / (Param (',' Param)*)?) ')'
Unary = ('++' / '--' / '+' / '-' / '!' / '~') Unary / Cast / Switch / Primary ('++' / '--')*
Cast = PrimitiveCast Unary / ClassCast !('+' / '-' / '++' / '--') (Lambda / Unary)
@PrimitiveCast = '(' Primitive Dims ')'
@ClassCast = '(' Type ('&' Type)* ')'
Primary = Atom Suffix*
Suffix = '.' ('new' Creator / Annotation* TypeArgs? Id Args? / 'this' / 'super' Args? / 'class') / '[' Expr ']' / '::' TypeArgs? (Id / 'new')
Atom = NUMBER / STRING / 'true' / 'false' / 'null' / 'this' Args? / 'super' (Args / &('.' / '::')) / 'new' Creator / Par / 'void' '.' 'class'
  / Primitive Dims ('.' 'class' / '::' 'new') / ClassType ('[' ']')+ ('.' 'class' / '::' 'new') / Id TypeArgs ('.' ClassType)? '::' (Id / 'new') / Id Args / Id
Creator = TypeArgs? Annotation* (Primitive / ClassType) (Args ClassBody? / ('[' ']')+ ArrayInit / ('[' Expr ']')+ Dims)
"""

PYTHON = """
File = (NEWLINE / Statement)* EOF
Id = NAME / 'match' / 'case' / 'type'
Statement = Compound / Simple
Simple = Small (';' Small)* ';'? NEWLINE
Small = 'pass' / 'break' / 'continue' / 'return' Stars? / 'raise' (Expr ('from' Expr)?)? / 'global' Id (',' Id)* / 'nonlocal' Id (',' Id)* / 'del' Targets
  / 'assert' Expr (',' Expr)? / 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* / 'from' From / 'type' Id TypeParams? '=' Expr / Assignment
Dotted = Id ('.' Id)*
From = ('.' / '...')* Dotted 'import' Names / ('.' / '...')+ 'import' Names
Names = '*' / NameList / Named (',' Named)*
@NameList = '(' Named (',' Named)* ','? ')'
Named = Id ('as' Id)?
Assignment = Target ':' Expr ('=' (Yield / Stars))? / (Targets '=')+ (Yield / Stars) / Target AugOp (Yield / Stars) / (Yield / Stars) !'='
AugOp = '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
Targets = '*'? Target (',' '*'? Target)* ','?
Target = Atom (Call* Trail)+ !('(' / '[' / '.') / Id !('(' / '[' / '.') / TargetParen / TargetList
@TargetParen = '(' Targets? ')'
@TargetList = '[' Targets? ']'
Yield = 'yield' ('from' Expr / Stars?)
Stars = Star (',' Star)* ','?
Star = '*' Binary / Expr
Compound = If / For / While / Try / With / Def / Class / Match / Decorated
Block = Simple / NEWLINE Body
@Body = INDENT (NEWLINE / Statement)+ DEDENT
If = 'if' NamedExpr ':' Block ('elif' NamedExpr ':' Block)* Else?
Else = 'else' ':' Block
While = 'while' NamedExpr ':' Block Else?
For = 'async'? 'for' Targets 'in' Stars ':' Block Else?
Try = 'try' ':' Block (Except+ Else? Finally? / Finally)
Except = 'except' '*'? (Expr (',' Expr)* ('as' Id)?)? ':' Block
Finally = 'finally' ':' Block
With = 'async'? 'with' (WithParen / WithItem (',' WithItem)*) ':' Block
WithParen = WithItems &':'
@WithItems = '(' WithItem (',' WithItem)* ','? ')'
WithItem = Expr ('as' '*'? Target)?
Decorated = ('@' NamedExpr NEWLINE)+ (Def / Class)
Def = 'async'? 'def' Id TypeParams? Params ('->' Expr)? ':' Block
Class = 'class' Id TypeParams? Call? ':' Block
@TypeParams = '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam = ('*' / '**')? Id (':' Expr)? ('=' Expr)?
@Params = '(' ParamList? ')'
ParamList = (Param !'=' (',' Param !'=')* (',' '/')? (',' Default)* (',' '/' (',' Default)*)? / Default (',' Default)* (',' '/' (',' Default)*)?) (',' StarParams)? ','? / StarParams ','?
Param = Id (':' Expr)?
Default = Id (':' Expr)? '=' Expr
StarParams = '*' (Id (':' '*'? Expr)?)? (',' Id (':' Expr)? ('=' Expr)?)* (',' '**' Id (':' Expr)?)? / '**' Id (':' Expr)?
Match = 'match' Stars ':' NEWLINE Cases
@Cases = INDENT (NEWLINE / 'case' Pattern ('if' NamedExpr)? ':' Block)+ DEDENT
Pattern = StarPattern (',' StarPattern)* ','?
StarPattern = '*' Id / OrPattern ('as' Id)?
OrPattern = ClosedPattern ('|' ClosedPattern)*
ClosedPattern = '-'? NUMBER (('+' / '-') NUMBER)? / STRING+ / 'None' / 'True' / 'False' / Dotted PatternArgs? / PatternParen / PatternList / PatternDict
@PatternArgs = '(' (PatternArg (',' PatternArg)* ','?)? ')'
PatternArg = Id '=' StarPattern / StarPattern
@PatternParen = '(' Pattern? ')'
@PatternList = '[' Pattern? ']'
@PatternDict = '{' (PatternPair (',' PatternPair)* ','?)? '}'
PatternPair = '**' Id / ('-'? NUMBER / STRING+ / Dotted / 'None' / 'True' / 'False') ':' StarPattern
NamedExpr = Id ':=' Expr / Expr
Expr = Lambda / Binary ('if' Binary 'else' Expr)?
Lambda = 'lambda' LambdaParams? ':' Expr
LambdaParams = LambdaParam (',' LambdaParam)* ','?
LambdaParam = ('*' / '**') Id / '*' / '/' / Id ('=' Expr)?
Binary = Unary (BinaryOp Unary)*
BinaryOp = 'or' / 'and' / 'not' 'in' / 'in' / 'is' 'not'? / '==' / '!=' / '<=' / '>=' / '<' / '>' / '|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@' / '**'
Unary = ('not' / '-' / '+' / '~' / 'await')* Primary
Primary = Atom (Call / Trail)*
Trail = '.' Id / Subscript
@Call = '(' (Positional (',' Positional)* (',' Keyword)* ','? / Keyword (',' Keyword)* ','?)? ')'
Positional = '*' Expr / !(Id '=') NamedExpr CompFor?
Keyword = Id '=' Expr / '*' Expr / '**' Expr
@Subscript = '[' Slice (',' Slice)* ','? ']'
Slice = '*' Binary / Expr? ':' Expr? (':' Expr?)? / NamedExpr
Atom = Id / NUMBER / STRING+ / 'None' / 'True' / 'False' / '...' / Paren / List / Dict
@Paren = '(' (Yield / Item (CompFor / (',' Item)* ','?))? ')'
@List = '[' (Item (CompFor / (',' Item)* ','?))? ']'
Item = '*' Binary / NamedExpr
@Dict = '{' (Pair (CompFor / (',' Pair)* ','?) / Item (CompFor / (',' Item)* ','?))? '}'
Pair = '**' Binary / Expr ':' Expr
CompFor = 'async'? 'for' Targets 'in' (Lambda / Binary) ('if' (Id ':=' Binary / Binary) / CompFor)*
"""

_SCRIPT_WORDS = (
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with yield let static async await of get set from as"
).split()

SCRIPT = """
File = Statement* EOF
Id = NAME / 'async' / 'of' / 'get' / 'set' / 'from' / 'as' / 'static' / 'await' / 'yield' / 'let'
Semi = ';' / &'}' / EOF / NL
@Block = '{' Statement* '}'
Statement = Block / ';' / Declaration / 'if' Par Statement ('else' Statement)? / For / 'while' Par Statement / 'do' Statement 'while' Par ';'? / Switch / Try / 'with' Par Statement
  / 'return' (NONL Expr)? Semi / 'throw' NONL Expr Semi / 'break' (NONL Id)? Semi / 'continue' (NONL Id)? Semi / 'debugger' Semi / Import / Export / Id ':' Statement
  / !('{' / 'function' / 'class' / 'async' NONL 'function') Expr Semi
Declaration = ('var' / 'const' / 'let' &(Id / '{' / '[')) Declarator (',' Declarator)* Semi / Function / Class
Declarator = Binding ('=' Assign)?
Binding = Id / ObjectPattern / ArrayPattern
@ObjectPattern = '{' (PatternItem (',' PatternItem)*)? ','? '}'
PatternItem = '...' Binding / PropName ':' Binding ('=' Assign)? / Id ('=' Assign)?
@ArrayPattern = '[' ','* ('...'? Binding ('=' Assign)? (','+ '...'? Binding ('=' Assign)?)*)? ','* ']'
Function = 'async'? 'function' '*'? Id? Params Block
@Params = '(' (Param (',' Param)*)? ','? ')'
Param = '...'? Binding ('=' Assign)?
Class = 'class' (!'extends' Id)? ('extends' Left)? ClassBody
@ClassBody = '{' (';' / Member)* '}'
Member = 'static' Block / ('static' !('(' / '=' / ';' / '}'))? (('get' / 'set') !('(' / '=' / ';' / '}') PropName Params Block / ('async' NONL !('(' / '=' / ';' / '}'))? '*'? PropName Params Block / PropName ('=' Assign)? Semi)
PropName = Word / STRING / NUMBER / PRIVATE / Computed
@Computed = '[' Assign ']'
@Par = '(' Expr ')'
For = 'for' 'await'? ForHead Statement
@ForHead = '(' (('var' / 'const' / 'let') Binding ('of' Assign / 'in' Expr) / Left ('of' Assign / 'in' Expr) / (('var' / 'const' / 'let') Declarator (',' Declarator)* / Expr)? ';' Expr? ';' Expr?) ')'
Switch = 'switch' Par SwitchBody
@SwitchBody = '{' (('case' Expr / 'default') ':' Statement*)* '}'
Try = 'try' Block ('catch' CatchHead? Block ('finally' Block)? / 'finally' Block)
@CatchHead = '(' Binding ')'
Import = 'import' (STRING / ImportWhat 'from' STRING) With? Semi
With = 'with' Object
ImportWhat = Id (',' ('*' 'as' Id / ImportList))? / '*' 'as' Id / ImportList
@ImportList = '{' (ImportItem (',' ImportItem)*)? ','? '}'
ImportItem = (Word / STRING) 'as' Id / Id
Export = 'export' ('default' (Function / Class / Assign Semi) / '*' ('as' (Word / STRING))? 'from' STRING Semi / ExportList ('from' STRING)? Semi / Declaration)
@ExportList = '{' (ExportItem (',' ExportItem)*)? ','? '}'
ExportItem = (Word / STRING) ('as' (Word / STRING))?
Expr = Assign (',' Assign)*
Assign = Arrow / 'yield' (NONL ('*' Assign / Assign))? / Ternary (AssignOp Assign)?
AssignOp = '=' / '+=' / '-=' / '*=' / '**=' / '/=' / '%=' / '<<=' / '>>=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
Arrow = ('async' NONL)? (Id / Params) NONL '=>' (Block / !'{' Assign)
Ternary = Binary ('?' Assign ':' Assign)?
Binary = Unary (BinaryOp Unary)*
BinaryOp = '&&' / '||' / '??' / '===' / '!==' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '+' / '-' / '**' / '*' / '/' / '%' / '&' / '|' / '^' / 'instanceof' / 'in'
Unary = ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await') Unary / Left (NONL ('++' / '--'))?
Left = (New / Primary) Suffix*
New = 'new' ('.' Word / (New / Primary) Plain* Args?)
Plain = '.' (Word / PRIVATE) / Index / Template
Suffix = Plain / '?.' (Args / Index / Word / PRIVATE) / Args
@Index = '[' Expr ']'
@Args = '(' (Arg (',' Arg)*)? ','? ')'
Arg = '...'? Assign
Template = TEMPLATE / HEAD Expr (MIDDLE Expr)* TAIL
Primary = NUMBER / STRING / REGEX / Template / 'this' / 'super' / 'null' / 'true' / 'false' / Function / Class / Array / Object / Par / 'import' (Args / '.' Word) / PRIVATE / Id
@Array = '[' ','* (Arg (','+ Arg)*)? ','* ']'
@Object = '{' (Property (',' Property)*)? ','? '}'
Property = '...' Assign / ('get' / 'set') PropName Params Block / ('async' NONL)? '*'? PropName Params Block / PropName ':' Assign / Id ('=' Assign)?
"""

#: What elements add to the grammars of scripts.
MARKUP = """
Primary = NUMBER / STRING / REGEX / Template / Element / 'this' / 'super' / 'null' / 'true' / 'false' / Function / Class / Array / Object / Par / 'import' (Args / '.' Word) / PRIVATE / Id
Element = JSX / JOPEN (JVALUE Expr '}' / JSPREAD Assign '}' / JCHILD ('...' Assign / Expr)? '}')* JCLOSE
"""

_TYPED_WORDS = (
    "abstract any asserts declare enum implements infer interface is keyof module namespace never override private protected public readonly require "
    "satisfies type unique accessor global out"
).split()

TYPED = """
Id = NAME / 'async' / 'of' / 'get' / 'set' / 'from' / 'as' / 'static' / 'await' / 'yield' / 'let' / 'abstract' / 'any' / 'asserts' / 'declare' / 'implements' / 'infer' / 'interface' / 'is'
  / 'keyof' / 'module' / 'namespace' / 'never' / 'override' / 'private' / 'protected' / 'public' / 'readonly' / 'require' / 'satisfies' / 'type' / 'unique' / 'accessor' / 'global' / 'out'
Declaration = ('var' / 'const' !'enum' / 'let' &(Id / '{' / '[')) Declarator (',' Declarator)* Semi / Function / 'abstract'? Class / Decorator+ 'export'? 'default'? 'abstract'? Class / Interface / Alias / Enum / Namespace / 'declare' Declaration
Decorator = '@' Left
Declarator = Binding '!'? Typing? ('=' Assign)?
Function = 'async'? 'function' '*'? Id? TypeParams? Params Returns? (Block / Semi)
Param = Decorator* (('public' / 'private' / 'protected' / 'readonly' / 'override') &(Id / '{' / '[' / 'this'))* '...'? (Binding / 'this') '?'? Typing? ('=' Assign)?
Class = 'class' (!('extends' / 'implements' !('{' / '<')) Id)? TypeParams? ('extends' Left TypeArgs?)? ('implements' Type (',' Type)*)? ClassBody
Member = 'static' Block / (Decorator / MemberMod)* (IndexSign Semi / ('get' / 'set') !End PropName Params Returns? (Block / Semi) / ('async' NONL !End)? '*'? PropName '?'? TypeParams? Params Returns? (Block / Semi) / PropName ('?' / '!')? Typing? ('=' Assign)? Semi)
MemberMod = ('public' / 'private' / 'protected' / 'static' / 'readonly' / 'abstract' / 'override' / 'declare' / 'accessor') !End
End = '(' / '=' / ';' / '}' / ':' / '?' / '!' / '<' / ','
IndexSign = '[' Id ':' Type ']' Typing
CatchHead = '(' Binding Typing? ')'
Import = 'import' ('type' !('from' / ',' / '='))? (STRING / ImportWhat 'from' STRING / Id '=' ('require' Args / Dotted)) With? Semi
ImportItem = 'type' (Word 'as' Id / Id) / (Word / STRING) 'as' Id / Id
Export = Decorator* 'export' ('default' (Function / 'abstract'? Class / Interface / Assign Semi) / 'type'? '*' ('as' (Word / STRING))? 'from' STRING Semi / 'type'? ExportList ('from' STRING)? Semi / '=' Assign Semi / 'as' 'namespace' Id Semi / 'import' Id '=' ('require' Args / Dotted) Semi / Declaration)
ExportItem = 'type' (Word / STRING) ('as' (Word / STRING))? / (Word / STRING) ('as' (Word / STRING))?
Interface = 'interface' Id TypeParams? ('extends' Type (',' Type)*)? ObjectType
Alias = 'type' NONL Id TypeParams? '=' Type Semi
Enum = 'const'? 'enum' Id EnumBody
@EnumBody = '{' (PropName ('=' Assign)? (',' PropName ('=' Assign)?)*)? ','? '}'
Namespace = ('namespace' / 'module' / 'global') (Dotted / STRING)? (Block / Semi)
Dotted = Id ('.' Word)*
Typing = ':' Type
Returns = ':' (Predicate / Type)
Predicate = 'asserts' (Id / 'this') ('is' Type)? / (Id / 'this') NONL 'is' Type
@Generic = '<' TypeParam (',' TypeParam)* ','? '>'
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam = ('const' / 'in' / 'out')* Id ('extends' Type)? ('=' Type)?
TypeArgs = '<' Type (',' Type)* '>'
Type = FunctionType / Union ('extends' Type '?' Type ':' Type)?
FunctionType = ('abstract'? 'new')? TypeParams? Params '=>' (Predicate / Type)
Union = '|'? Intersection ('|' Intersection)*
Intersection = '&'? TypeUnary ('&' TypeUnary)*
TypeUnary = ('keyof' / 'unique' / 'readonly') TypeUnary / 'infer' Id ('extends' Union)? / TypePrimary (NONL '[' Type? ']')*
TypePrimary = TypeParen / Tuple / ObjectType / 'typeof' ('import' Args / Dotted / 'this') TypeArgs? / 'import' Args ('.' Word)* TypeArgs? / TEMPLATE / HEAD Type (MIDDLE Type)* TAIL / STRING / '-'? NUMBER / 'this' / 'null' / 'true' / 'false' / 'void' / (Id / 'function') ('.' Word)* (NONL TypeArgs)?
@TypeParen = '(' Type ')'
@Tuple = '[' (TupleItem (',' TupleItem)*)? ','? ']'
TupleItem = '...'? Word '?'? ':' '...'? Type / '...'? Type '?'?
@ObjectType = '{' (('+' / '-')? 'readonly')? '[' Id 'in' Type ('as' Type)? ']' (('+' / '-')? '?')? Typing? (';' / ',')? '}' / '{' (TypeMember (';' / ',' / NL / &'}'))* '}'
TypeMember = 'new'? TypeParams? Params Returns? / ('readonly' !('?' / ':' / '(' / '<'))? IndexSign / ('get' / 'set') !('?' / ':' / '(' / '<' / ';' / ',') PropName Params Returns? / ('readonly' !('?' / ':' / '(' / '<' / ';' / ','))? PropName '?'? (TypeParams? Params Returns? / Typing?)
Arrow = ('async' NONL)? (Id / TypeParams? Params Returns?) NONL '=>' (Block / !'{' Assign)
Binary = Unary (BinaryOp Unary / NONL ('as' / 'satisfies') ('const' / Type))*
Unary = ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await') Unary / TypeArgs !'(' Unary / Left (NONL ('++' / '--'))?
New = 'new' ('.' Word / (New / Primary) Plain* TypeArgs? Args?)
Plain = '.' (Word / PRIVATE) / Index / Template / NONL '!'
Suffix = Plain / '?.' (Args / Index / Word / PRIVATE) / Args / TypeArgs &('(' / TEMPLATE / HEAD / ')' / ',' / ';') Args?
PatternItem = '...' Binding / PropName ':' Binding ('=' Assign)? / Id ('=' Assign)?
Property = '...' Assign / ('get' / 'set') PropName Params Returns? Block / ('async' NONL)? '*'? PropName TypeParams? Params Returns? Block / PropName ':' Assign / Id ('=' Assign)?
"""

_KOTLIN_SOFT = (
    "public private internal protected abstract final open override lateinit inline noinline crossinline suspend operator infix data sealed enum annotation inner "
    "const vararg tailrec external companion expect actual value reified by get set init constructor where file import dynamic field property receiver param setparam delegate catch finally out"
).split()
_KOTLIN_MODS = (
    "public private internal protected abstract final open override lateinit inline noinline crossinline suspend operator infix data sealed enum annotation inner "
    "const vararg tailrec external companion expect actual value reified"
).split()

KOTLIN = """
File = FileAnnotation* ('package' Name Sep)? (Import Sep)* (';' / Declaration Sep)* EOF
FileAnnotation = '@' 'file' ':' (Name Args? / '[' (Name Args?)+ ']')
Import = 'import' Name ('.' '*')? ('as' Id)?
Name = Id ('.' (Id / Word))*
Sep = ';'+ / EOF / NL / &'}'
Annotation = '@' ((Id ':')? Name (NONL TypeArgs)? (NONL Args)? / (Id ':')? '[' (Name Args?)+ ']')
Mods = (Annotation / Modifier !(':' / ')' / ',' / '=' / '.' / '?.' / '(' / '[' / '+=' / '-=' / '++' / '--' / '->'))*
Declaration = Mods (ClassDecl / ObjectDecl / FunDecl / PropDecl / AliasDecl)
ClassDecl = ('class' / 'fun'? 'interface') Id TypeParams? (Mods 'constructor')? ClassParams? (':' Supers)? Where? (EnumBody / ClassBody)?
ObjectDecl = 'companion'? 'object' (NONL Id)? (':' Supers)? ClassBody?
@ClassParams = '(' (ClassParam (',' ClassParam)*)? ','? ')'
ClassParam = Mods ('val' / 'var')? Id ':' Type ('=' Expr)?
Supers = Super (',' Super)*
Super = Annotation* UserType (NONL Args / 'by' Expr)? / Type
Where = 'where' Id ':' Type (',' Id ':' Type)*
@ClassBody = '{' (';' / Member Sep)* '}'
@EnumBody = '{' EnumItem (',' EnumItem)* ','? (';' (';' / Member Sep)*)? '}'
EnumItem = Annotation* Id (NONL Args)? (NONL ClassBody)?
Member = 'init' Block / Mods 'constructor' Params (':' ('this' / 'super') Args)? Block? / Declaration
FunDecl = 'fun' TypeParams? FunName Params (':' Type)? Where? (Block / '=' Expr)?
FunName = (TypeParen '?'? '.')? (Id TypeArgs? '?'? '.')* Id
@Params = '(' (Param (',' Param)*)? ','? ')'
Param = Mods Id ':' Type ('=' Expr)?
PropDecl = ('val' / 'var') TypeParams? (Destructure / FunName) (':' Type)? Where? ('=' Expr / 'by' Expr)? (';'? Accessor)*
Accessor = Mods ('get' (NONL '(' ')' (':' Type)? (Block / '=' Expr))? / 'set' (NONL '(' Mods Id (':' Type)? ','? ')' (':' Type)? (Block / '=' Expr))?) &(NL / ';' / '}' / EOF)
@Destructure = '(' Id (':' Type)? (',' Id (':' Type)?)* ','? ')'
AliasDecl = 'typealias' Id TypeParams? '=' Type
TypeParams = '<' Mods ('in' / 'out')? Id (':' Type)? (',' Mods ('in' / 'out')? Id (':' Type)?)* ','? '>'
TypeArgs = '<' TypeArg (',' TypeArg)* ','? '>'
TypeArg = '*' / ('in' / 'out' !(',' / '>'))? Type
Type = Annotation* 'suspend'? (FunctionType / (TypeParen / UserType) '?'* ('&' Type)?)
FunctionType = ((TypeParen / UserType) '?'? '.')? TypeList '->' Type
@TypeList = '(' ((Id ':')? Type (',' (Id ':')? Type)*)? ','? ')'
@TypeParen = '(' Type ')'
UserType = Id (NONL TypeArgs)? ('.' Id (NONL TypeArgs)?)*
@Block = '{' (';' / Statement Sep)* '}'
Statement = (Annotation)* (Id '@')? (Loop / Declaration / Assignment / Expr)
Assignment = Postfix ('=' / '+=' / '-=' / '*=' / '/=' / '%=') Expr
Loop = 'for' ForHead Body? / 'while' Par (Body / ';')? / 'do' Body? 'while' Par
@ForHead = '(' Annotation* (Destructure / Id (':' Type)?) 'in' Expr ')'
@Par = '(' Expr ')'
Body = Block / Statement
Expr = Unary Tail*
Tail = ('&&' / '||' / '?:') Unary / NONL (('as' / 'as?') Type / ('is' / '!is') Type / ('in' / '!in' / '==' / '!=' / '===' / '!==' / '<=' / '>=' / '<' / '>' / '..<' / '..' / '+' / '-' / '*' / '/' / '%') Unary / !Stop Id NONL Unary)
Stop = 'get' (NONL '(' ')') &('=' / '{')
Unary = Annotation* (Id '@')? (('-' / '+' / '!' / '++' / '--') Unary / Postfix)
Postfix = Primary Suffix*
Suffix = NONL ('++' / '--' / '!!') / NONL TypeArgs (Args Lambda? / Lambda) / NONL Args (NONL Label? Lambda)? / NONL Label? Lambda / NONL Index / ('.' / '?.') (Id / Word / Par) / '::' (Id / 'class') / NONL TypeArgs &('::' / '.')
Label = Id '@'
@Index = '[' Expr (',' Expr)* ','? ']'
@Args = '(' (Arg (',' Arg)*)? ','? ')'
Arg = Annotation* (Id '=' !'=')? '*'? Expr
Primary = NUMBER / STRING / 'true' / 'false' / 'null' / 'this' ('@' Id)? / 'super' (TypeArgs)? ('@' Id)? / If / When / Try / Jump / ObjectExpr / FunExpr / Par / Lambda / Index / '::' (Id / 'class') / Id
If = 'if' Par (Body (';'? 'else' Body)? / ';'? 'else' Body / ';')
When = 'when' WhenHead? WhenBody
@WhenHead = '(' (Annotation* 'val' Id (':' Type)? '=')? Expr ')'
@WhenBody = '{' (';' / WhenItem Sep)* '}'
WhenItem = ('else' ('if' Expr)? / Condition (',' Condition)* ','? ('if' Expr)?) '->' Body
Condition = ('in' / '!in') Expr / ('is' / '!is') Type / Expr
Try = 'try' Block ('catch' CatchHead Block)* ('finally' Block)?
@CatchHead = '(' Annotation* Id ':' Type ','? ')'
Jump = 'throw' Expr / 'return' ('@' Id)? (NONL Expr)? / ('break' / 'continue') ('@' Id)?
ObjectExpr = 'data'? 'object' (':' Supers)? ClassBody?
FunExpr = 'suspend'? 'fun' (Type '.')? Params (':' Type)? (Block / '=' Expr)?
@Lambda = '{' ((LambdaParam (',' LambdaParam)* ','?)? '->')? (';' / Statement Sep)* '}'
LambdaParam = Destructure (':' Type)? / Id (':' Type)?
"""

_KOTLIN_HARD = (
    "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while"
).split()


def _words(name: str, words: list[str]) -> str:
    return f"{name} = NAME / " + " / ".join(f"'{w}'" for w in words)


def _over(base: str, more: str) -> str:
    """base with the rules of more in place of its own of the same name; new ones at the end."""
    import re

    rules: dict[str, str] = {}
    for text in (base, more):
        for line in filter(str.strip, re.sub(r"\n[ \t]+(?=\S)", " ", text).split("\n")):
            name = line.partition(" = ")[0].strip().lstrip("@")
            rules[name] = line
    return "\n".join(rules.values())


@cache
def grammar(language: str) -> Grammar:
    """The compiled grammar of a language, made once in each process."""
    plain = ("NAME", "NUMBER", "STRING")
    script = (*plain, "TEMPLATE", "HEAD", "MIDDLE", "TAIL", "REGEX", "PRIVATE")
    if language == "java":
        return Grammar(JAVA, plain)
    if language == "python":
        return Grammar(PYTHON, (*plain, "NEWLINE", "INDENT", "DEDENT"))
    markup = ("JSX", "JOPEN", "JVALUE", "JSPREAD", "JCHILD", "JCLOSE")
    if language == "javascript":
        return Grammar(SCRIPT + _words("Word", _SCRIPT_WORDS), script)
    if language == "jsx":
        return Grammar(_over(SCRIPT, MARKUP) + "\n" + _words("Word", _SCRIPT_WORDS), script + markup)
    if language == "typescript":
        return Grammar(_over(SCRIPT, TYPED) + "\n" + _words("Word", _SCRIPT_WORDS + _TYPED_WORDS), script)
    if language == "tsx":
        return Grammar(_over(_over(SCRIPT, TYPED), MARKUP) + "\n" + _words("Word", _SCRIPT_WORDS + _TYPED_WORDS), script + markup)
    if language == "kotlin":
        soft = _words("Id", _KOTLIN_SOFT) + "\n" + "Modifier = " + " / ".join(f"'{w}'" for w in _KOTLIN_MODS)
        return Grammar(KOTLIN + soft + "\n" + _words("Word", _KOTLIN_HARD), plain)
    raise ValueError(language)
