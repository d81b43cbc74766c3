"""functions of the document pipeline and its operational analytics."""
