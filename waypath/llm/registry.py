"""The queries of this subpackage, and their SQL where SQL can express them."""

from waypath.llm.decontaminate import ORACLE as LEAKS_SQL
from waypath.llm.decontaminate import op1_decontaminate
from waypath.llm.doubling import ORACLE as WINDOWS_SQL
from waypath.llm.doubling import op4_windows
from waypath.llm.forest import op9_forest
from waypath.llm.lines import ORACLE as LINES_SQL
from waypath.llm.lines import op7_lines
from waypath.llm.packing import op6_packing
from waypath.llm.pii import op10_pii
from waypath.llm.secrets import ORACLE as SECRETS_SQL
from waypath.llm.secrets import op5_secrets
from waypath.llm.simhash import op3_simhash
from waypath.llm.suffix import ORACLE as SUBSTRINGS_SQL
from waypath.llm.suffix import op2_substrings
from waypath.llm.toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_substrings, op3_simhash, op4_windows, op5_secrets, op6_packing, op7_lines, op8_toxicity, op9_forest, op10_pii)
}
ORACLE_SQL = {"op1_decontaminate": LEAKS_SQL, "op2_substrings": SUBSTRINGS_SQL, "op4_windows": WINDOWS_SQL, "op5_secrets": SECRETS_SQL, "op7_lines": LINES_SQL}
