def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""))
