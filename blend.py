"""For spark-submit: blend.py inspect|merge config.yaml"""

from corpus_blend.__main__ import main

if __name__ == "__main__":
    main()
