"""What tests share."""

import pandas as pd

DATA = "/root/testdata/sf0.001"


def rows_of(pdf):
    """Rows with columns by name, null as None, in a stable order."""
    columns = sorted(pdf.columns)
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x.item() if hasattr(x, "item") else x
    return columns, sorted([tuple(plain(x) for x in r) for r in pdf[columns].itertuples(index=False, name=None)], key=repr)
