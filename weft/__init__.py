"""weft: data-processing operators for facts, text and logs, written on the PySpark DataFrame API.

Every operator is a function from DataFrames to a DataFrame. Nothing in this
package starts a session or collects a table: the caller owns the session, and
Catalyst plans what the functions declare.
"""

__version__ = "0.1.0"
