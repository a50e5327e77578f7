"""The two tokenizer operators' shared parts: distinct pieces in a trie, walked depth first."""

from __future__ import annotations


def trie_walk(words, enter, root):
    """Yields (word, state) of distinct ``words`` (sequences of symbols), each shared prefix entered once.

    ``enter(path, states)`` gives the state after the last symbol of ``path``;
    ``states[i]`` is the state of its first i symbols, ``states[0]`` is ``root``.
    The words are walked in sorted order, which visits their trie depth first
    while holding one path only: memory is that of the longest word.
    """
    path: list = []
    states = [root]
    for word in sorted(words):
        n, keep = min(len(path), len(word)), 0
        while keep < n and path[keep] == word[keep]:
            keep += 1
        del path[keep:]
        del states[keep + 1 :]
        for symbol in word[keep:]:
            path.append(symbol)
            states.append(enter(path, states))
        yield word, states
