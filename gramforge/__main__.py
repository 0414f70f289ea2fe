from gramforge.cli import main

raise SystemExit(main())
