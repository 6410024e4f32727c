"""Word lists, patterns, weights and formats that results depend on. They are data; the rules that use them are elsewhere."""

# Words of a query that say nothing of files or symbols, and more that say nothing of code.
STOP_WORDS = frozenset(
    """the a an in for of and or is are how does what where show me find get use uses used to from with this that it its by be do did has have not can all any my our
    which when then there their about into should would could will may might was were been being just also more like than but so if at on""".split()
)
CODE_STOP_WORDS = STOP_WORDS | frozenset("return def class import from pass self".split())

# Parts of paths that name no domain.
NOISE = tuple(
    """py js ts rs jsx tsx pyc pyd src lib bin obj dist build out test tests spec example examples init main index conf config utils helpers base common core impl
    interface abstract model models schema controller service repository view views template templates static assets public private protected internal external
    default unknown""".split()
)

# Paths of test files in retrieval, without regard to case; and the marks of test and mock files that phases look for.
TEST_PATHS = (r"(^|/)tests?/", r"(^|/)test_", r"_test\.(py|js|ts|rs)$", r"\.spec\.(js|ts)$")
TEST_MARKS = ("test_", "_test.", ".spec.", "/test/", "/tests/", "/spec/", "_spec.", "mock_", "_mock.")
MOCK_MARKS = ("mock", "stub")

# Questions about callers, definitions and impact, without regard to case; identifiers; and words of a question, in lower case, that are no target (I isn't one of them).
CALLERS = r"\b(callers?\s+of|who\s+calls|what\s+calls|find\s+callers|calls?\s+to)\b"
DEFINED = r"\bwhere\s+is\b.+\bdefined\b"
IMPACT = r"\b(imports?\s+|who\s+imports|what\s+imports|depends\s+on|dependent|impact\s+of|what\s+breaks|affect|refactor)\b"
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_.]*"
ASKING = tuple(
    """calls imports what who where is of the on if change affect find callers caller import impacts impact breaks depends dependent refactor defined how does show me a an""".split()
)

# Factors of symbol, path and domain boost by kind of query, and the boosts.
FACTORS = {"symbol": (1.5, 0.5, 0.3), "path-dominant": (0.5, 1.5, 0.5), "semantic-dominant": (0.2, 0.2, 0.2)}
BOOSTS = (0.3, 0.2, 0.25)
# What makes a query one for symbols: a name of joined capitalised words.
JOINED_WORDS = r"\b[A-Z][a-z]+[A-Z]"
